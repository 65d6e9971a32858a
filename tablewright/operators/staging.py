"""Written intermediate tables.

A stage cuts lineage and lets several readers share one result.  It lives in
the shared folder the session names in ``spark.checkpoint.dir``, so it survives
lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def staging_root(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tablewright-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a scan of it (columns prunable, names unrestricted)."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/tablewright/{label}-{uuid.uuid4().hex}"
    # positional names: parquet would reject headers that differ only in case
    fields = [
        T.StructField(f"c{i}", T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType)
        for i, f in enumerate(df.schema.fields)
    ]
    plain = df.toDF(*[f.name for f in fields])
    for source, field in zip(df.schema.fields, fields):
        if isinstance(source.dataType, T.NullType):
            plain = plain.withColumn(field.name, plain[field.name].cast("string"))
    plain.write.parquet(path)
    return spark.read.schema(T.StructType(fields)).parquet(path).toDF(*df.columns)

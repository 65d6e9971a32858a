"""Results, split parts and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.names import named, unused
from tablewright.operators.compare import sink_order
from tablewright.operators.identity import ROW_ID
from tablewright.operators.schema import data_columns, restored_header, sink_cells
from tablewright.operators.split import BUCKET, CHUNK, with_file_label

RECORDS_PER_FILE = 5_000_000


def _save(
    df: DataFrame, path: str, fmt: str, mode: str, parts: list[str] | None = None, records_per_file: int = RECORDS_PER_FILE
) -> None:
    df = df.toDF(*[restored_header(c, df.columns) for c in df.columns])
    cells = [f for f in df.schema.fields if f.name not in (parts or [])]
    if fmt == "csv" and len(cells) == 1 and isinstance(cells[0].dataType, T.StringType):
        # a missing cell alone in its row would be a blank line, which readers skip
        df = df.withColumns({cells[0].name: F.coalesce(named(cells[0].name), F.lit(""))})
    writer = df.write.mode(mode).option("maxRecordsPerFile", records_per_file)
    if parts:
        writer = writer.partitionBy(*parts)
    if fmt == "csv":
        # the writer would trim cells otherwise
        writer.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}; use csv or parquet")


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in ``order``, whose values are taken once for each row; a sort would take them anew whenever it compares two."""
    taken = {unused(df.columns, f"_sort{i}"): c for i, c in enumerate(order)}
    return df.withColumns(taken).orderBy(*taken).drop(*taken)


def write_result(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", order_by: list[str | Column] | None = None
) -> None:
    """Write the table to hand on: identifiers and dates as text, bookkeeping columns left out.

    For the result of a comparison, ``order_by=report_order(result)`` gives sections and keys in turn.
    """
    if order_by:
        df = df.orderBy(*[named(c) if isinstance(c, str) else c for c in order_by])
    _save(sink_cells(df.select(*[named(c) for c in data_columns(df)])), path, fmt, mode)


def write_split(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", manifest: DataFrame | None = None
) -> None:
    """Write one folder per part of a bucketed or chunked table, named by the part's value or number.

    With the ``manifest`` of a split by field, folders bear its file labels.
    Rows are brought together per part, and adaptive execution cuts parts above
    the advisory partition size into several tasks, so one large part is not one
    task's work.
    """
    place = [F.col(ROW_ID)] if ROW_ID in df.columns else []
    columns = [named(c) for c in data_columns(df)]
    if manifest is not None and BUCKET in df.columns:
        label = unused(df.columns, "_label")
        df, part = with_file_label(df, manifest, label), F.col(label)
    else:
        part = F.col(BUCKET if BUCKET in df.columns else CHUNK).cast("string")
    cells = sink_cells(df.select(*columns, part.alias("part"), *place))
    # in table order inside each file; the writer keeps an order that begins with the part
    ordered = cells.hint("rebalance", "part").sortWithinPartitions("part", *place)
    _save(ordered.drop(ROW_ID), path, fmt, mode, ["part"])


def split_files(spark: SparkSession, path: str, manifest: DataFrame, fmt: str = "parquet") -> DataFrame:
    """The manifest of a split by field with what lies in the folders written: ``written_rows`` and ``n_files``.

    A part without a folder has null in both; a folder that no part names has a
    row of its own, with the label alone.  Of Parquet files only footers are read.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    files = reader.format(fmt).schema("part string").load(path).groupBy("part", F.col("_metadata.file_path").alias("file"))
    held = files.agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.sum("n").alias("written_rows"), F.count("file").alias("n_files"))
    return manifest.join(held.withColumnRenamed("part", "file_label"), "file_label", "full")


def report_order(table: DataFrame) -> list[Column]:
    """The order people read a report table in: sections of a comparison, result rows, parts; none for counts."""
    names = set(table.columns)
    if {"_status", "_key", "_ord"} <= names:
        return sink_order()
    if "result_row" in names:
        return [F.col(c) for c in ("result_row", "seq") if c in names]
    return [F.col(c) for c in ("seq", "chunk", ROW_ID) if c in names][:1]


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write the audit tables of a job side by side as ``<path>/<table>``, each in reading order."""
    for name, table in tables.items():
        order = report_order(table)
        plain = (_sorted(table, order) if order else table).drop(ROW_ID)
        if fmt == "csv":
            plain = plain.select(
                *[
                    F.array_join(named(f.name), "||").alias(f.name) if f.dataType.typeName() == "array" else named(f.name)
                    for f in plain.schema.fields
                ]
            )
        _save(plain, f"{path}/{name}", fmt, mode)


def output_layout(root: str, task: str, stem: str, stamp: str, output_name: str | None = None) -> dict[str, str]:
    """Paths of a run: ``<root>/<task>/<stem>/{result,report}_<stamp>``; the stamp is given by the caller."""
    base = f"{root.rstrip('/')}/{task}/{_file_stem(stem)}"
    result = f"{root.rstrip('/')}/{output_name}" if output_name else f"{base}/result_{stamp}"
    return {"result": result, "report": f"{base}/report_{stamp}"}


def _file_stem(text: str, fallback: str = "output") -> str:
    """Driver-side counterpart of ``safe_label`` for one path element."""
    words = text.strip()
    if words.lower() in ("", "nan", "none", "nat"):
        words = fallback
    for forbidden in '\\/:*?"<>|':
        words = words.replace(forbidden, "_")
    return " ".join(words.split()).strip(" .")[:80] or fallback

"""Split one table by field or by row count, with a manifest of the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.constants import BLANK_BUCKET, DEFAULT_ROWS_PER_CHUNK
from tablewright.functions.names import named, unused
from tablewright.functions.text import is_blank, plain_text, safe_label
from tablewright.operators.identity import BLOCK_BITS, ROW_ID, global_position, occurrence_ordinal, rank_rows
from tablewright.operators.schema import require_columns
from tablewright.operators.staging import stage

BUCKET = "_bucket"
CHUNK = "_chunk"


def _split_value(df: DataFrame, column: str) -> Column:
    return plain_text(named(column), df.schema[column].dataType)


def with_bucket(df: DataFrame, column: str) -> DataFrame:
    """Add ``_bucket``: the text of the split field, null when it is blank.

    The value itself identifies the part; the file label is only a label.
    """
    require_columns(df, [column], "split column")
    value = _split_value(df, column)
    return df.withColumn(BUCKET, F.when(~is_blank(value, "split"), value))


def split_blank_key(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a split value, rows to complete by hand)."""
    bucketed = with_bucket(df, column)
    return bucketed.filter(F.col(BUCKET).isNotNull()), bucketed.filter(F.col(BUCKET).isNull()).drop(BUCKET)


def distinct_groups(df: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """(_bucket, n_rows, first_row) per part."""
    return (
        with_bucket(df, column)
        .groupBy(BUCKET)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(row_id).alias("first_row"))
    )


def label_groups(groups: DataFrame, order: str = "first_row") -> DataFrame:
    """Add ``label`` and ``file_label``: the n-th part with the same label gets ``_n``."""
    # the blank part takes its label before any real group of that name
    labelled = groups.withColumn("_label", safe_label(F.col(BUCKET), BLANK_BUCKET)).withColumn(
        "_turn", F.when(F.col(BUCKET).isNull(), F.lit(-1)).otherwise(F.col(order))
    )
    numbered = occurrence_ordinal(labelled, ["_label"], "_turn", "_nth")
    suffix = F.when(F.col("_nth") > 1, F.concat(F.lit("_"), F.col("_nth").cast("string"))).otherwise(F.lit(""))
    return numbered.select(
        *[named(c) for c in groups.columns],
        F.col("_label").alias("label"),
        F.concat("_label", suffix).alias("file_label"),
        F.col("_nth").alias("nth"),
    )


def split_manifest(df: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """One row per part: file label, value, rows, first row and a note."""
    note = (
        F.when(F.col(BUCKET).isNull(), F.lit("blank_key"))
        .when(F.col("nth") > 1, F.lit("renamed"))
        .otherwise(F.lit(""))
    )
    # a row per part, which the labels read twice
    return label_groups(stage(distinct_groups(df, column, row_id), "groups")).select(
        "file_label", F.col(BUCKET).alias("value"), "n_rows", "first_row", note.alias("note")
    )


def group_sequence(manifest: DataFrame) -> DataFrame:
    """Number the parts in the order they are written: blank part first, then by first row."""
    turn = F.when(F.col("value").isNull(), F.lit(-1)).otherwise(F.col("first_row"))
    return rank_rows(manifest, [turn], "seq")


def chunk_by_rows(
    df: DataFrame, rows: int = DEFAULT_ROWS_PER_CHUNK, row_id: str = ROW_ID, bits: int = BLOCK_BITS
) -> DataFrame:
    """Add the 1-based ``_chunk``: chunk i holds rows (i-1)*rows … i*rows-1 in table order."""
    if rows < 1:
        raise ValueError("rows per part must be at least 1")
    at = unused(df.columns, "_at")
    placed = global_position(df, row_id, at, bits)
    return placed.withColumn(CHUNK, F.expr(f"{at} div {int(rows)} + 1")).drop(at)


def chunk_manifest(spark: SparkSession, total: int, rows: int = DEFAULT_ROWS_PER_CHUNK) -> DataFrame:
    """One row per part of a table of ``total`` rows: all hold ``rows`` rows but the last, which may be short."""
    last = -(-total // rows)
    held = F.least(F.lit(rows), F.lit(total) - (F.col("id") - 1) * rows).cast("bigint")
    return spark.range(1, last + 1).select(
        F.col("id").alias("chunk"),
        F.concat(F.lit("第"), F.col("id").cast("string"), F.lit(f"批_{rows}行")).alias("file_label"),
        held.alias("n_rows"),
        F.when(held < rows, F.lit("short")).otherwise(F.lit("")).alias("note"),
    )


def split_warnings(manifest: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """(kind, file_label, value, n_rows): parts to look at, and the tables (``name``) of ``empty``, which gave no part."""
    value = F.col("value") if "value" in manifest.columns else F.lit(None).cast("string").alias("value")
    found = manifest.filter(F.col("note") != "").select(F.col("note").alias("kind"), "file_label", value, "n_rows")
    if empty is None:
        return found
    nothing = F.lit(None).cast("string").alias("file_label")
    return found.unionByName(
        empty.select(F.lit("skipped_empty").alias("kind"), nothing, F.col("name").alias("value"), F.lit(0).cast("bigint").alias("n_rows"))
    )


def split_warning_text(warnings: DataFrame) -> DataFrame:
    """Add ``message``, the warning as people read it."""
    text = (
        F.when(F.col("kind") == "blank_key", F.format_string("「%s」有 %s 行没有拆分字段的值，请补全", "file_label", F.col("n_rows").cast("string")))
        .when(F.col("kind") == "renamed", F.format_string("「%s」的文件名与别的分组相同，改存为「%s」", "value", "file_label"))
        .when(F.col("kind") == "short", F.format_string("「%s」未满，只有 %s 行", "file_label", F.col("n_rows").cast("string")))
        .otherwise(F.format_string("「%s」是空表，没有输出", "value"))
    )
    return warnings.withColumn("message", text)


def split_summary(manifest: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row: parts, their rows, warnings and tables skipped because they are empty."""
    zero = F.lit(0).cast("bigint")
    parts = manifest.select("n_rows", F.lit(1).alias("part"), F.lit(0).alias("warned"), F.lit(0).alias("skipped"))
    skipped = (F.col("kind") == "skipped_empty").cast("int").alias("skipped")
    issues = warnings.select(zero.alias("n_rows"), F.lit(0).alias("part"), F.lit(1).alias("warned"), skipped)
    totals = {"part": "parts", "n_rows": "total_rows", "warned": "warnings", "skipped": "skipped"}
    return parts.unionByName(issues).agg(*[F.coalesce(F.sum(c), zero).alias(name) for c, name in totals.items()])


def with_file_label(bucketed: DataFrame, manifest: DataFrame, name: str = "file_label") -> DataFrame:
    """Add the label a bucketed row's part has in the manifest.

    Most labels follow from the value alone; only parts renamed because of a
    collision are looked up, and Spark broadcasts those where they are few.
    """
    number, key = unused(bucketed.columns, "_renamed"), unused(bucketed.columns, "_value")
    renamed = manifest.filter(F.col("note") == "renamed").select(F.col("value").alias(key), F.col("file_label").alias(number))
    joined = bucketed.join(renamed, F.col(BUCKET) == F.col(key), "left")
    label = F.coalesce(F.col(number), safe_label(F.col(BUCKET), BLANK_BUCKET))
    return joined.select(*[named(c) for c in bucketed.columns], label.alias(name))

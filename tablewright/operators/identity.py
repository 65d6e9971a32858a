"""Row identity, n-th occurrence and global row numbers.

Every operator that depends on table order takes a ``row_id`` column: a unique
``bigint`` that rises in table order.  Rows are numbered in blocks of ids, so no
window ever holds more rows than a block has ids, whatever the key distribution:

    rank inside (key, block)  +  rows of the key in earlier blocks

The second term comes from a pre-aggregated table of block counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.names import named, sheltered, unused
from tablewright.operators.staging import stage

ROW_ID = "_row_id"
BLOCK_BITS = 16  # ids per block
SPAN_BITS = 14  # blocks per span
MONOTONIC_BITS = 33  # row bits of monotonically_increasing_id
FILE_BITS = 40  # byte-position bits of a file-based row id

_BEFORE = (W.unboundedPreceding, -1)


def block_of(row_id: Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(row_id, bits)


def fingerprint(cells: list[tuple[Column, T.DataType]]) -> list[Column]:
    """Two 64-bit hashes that rows share if all cells are equal (nulls too), and else by a chance of 2**-128."""
    atomic = (T.StringType, T.NumericType, T.BooleanType, T.DatetimeType, T.BinaryType)
    # nested values as text: their hash passes over nulls
    plain = [c if isinstance(dtype, atomic) else F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) for c, dtype in cells]
    missing = F.concat_ws(",", *(F.when(c.isNull(), F.lit(str(i))) for i, c in enumerate(plain)))
    return [F.xxhash64(F.lit(seed), *plain, missing) for seed in (1, 2)]


def with_row_id(df: DataFrame, order_by: list[str] | None = None, unique: bool = False) -> DataFrame:
    """Add ``_row_id``.

    One integral ordering column that the caller vouches for as ``unique`` (and
    not null) is used as it is, without a job.  Other orders are ranked, equal
    rows in any order; without an order the rows keep the order they arrive in.
    The last two write a stage, so the ids stay fixed however often they are read.
    """
    if ROW_ID in df.columns:
        return df
    if order_by and unique and len(order_by) == 1 and isinstance(df.schema[order_by[0]].dataType, T.IntegralType):
        return df.withColumn(ROW_ID, F.col(order_by[0]).cast("bigint"))
    if order_by:
        return rank_rows(df, [named(c) for c in order_by], ROW_ID, start=0)
    return stage(df.withColumn(ROW_ID, F.monotonically_increasing_id()), "row-id")


def spread(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Rows dealt out evenly by their id.

    Scans are cut by bytes; where a row is much work, a well compressed file of
    many rows would be one long task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), named(row_id))


def block_counts(df: DataFrame, keys: list[str], row_id: str = ROW_ID, bits: int = BLOCK_BITS) -> DataFrame:
    """(keys, _block, _n, _offset): rows per block and rows of the key in earlier blocks."""
    counts = df.groupBy(*keys, block_of(F.col(row_id), bits).alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(*_BEFORE)
    return counts.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def rank_in_block(df: DataFrame, keys: list[str], row_id: str = ROW_ID, bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``_block`` and the 1-based ``_local`` rank inside (keys, block)."""
    local = W.partitionBy(*keys, "_block").orderBy(row_id)
    return df.withColumn("_block", block_of(F.col(row_id), bits)).withColumn("_local", F.row_number().over(local))


def occurrence_ordinal(
    df: DataFrame, keys: list[str], row_id: str = ROW_ID, name: str = "_ord", bits: int = BLOCK_BITS
) -> DataFrame:
    """1-based number of a row among the rows of its key, in table order; null is a key like any other."""
    # a key's first block needs no correction: the table joined is empty or small
    # unless keys repeat over long stretches of the table
    work, now = sheltered(df)
    keys, row_id = [now[k] for k in keys], now[row_id]
    offsets = block_counts(work, keys, row_id, bits).filter("_offset > 0").drop("_n")
    offsets = offsets.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.col("_block").alias("_ob"), "_offset")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)])
    ranked = rank_in_block(work, keys, row_id, bits)
    ranked = ranked.join(offsets, same & (F.col("_block") == F.col("_ob")), "left")
    ordinal = (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("bigint")
    return ranked.select(*[F.col(x).alias(c) for c, x in now.items()], ordinal.alias(name))


def global_position(
    df: DataFrame, row_id: str = ROW_ID, name: str = "_position", bits: int = BLOCK_BITS, span_bits: int = SPAN_BITS
) -> DataFrame:
    """0-based dense position of every row in ``row_id`` order, without a global sort."""
    work, now = sheltered(df)
    row_id = now[row_id]
    # one row per 65,536 ids, read for the sums of spans and of blocks
    blocks = stage(work.groupBy(block_of(F.col(row_id), bits).alias("_block")).agg(F.count(F.lit(1)).alias("_n")), "block-counts")
    blocks = blocks.withColumn("_span", F.shiftright("_block", span_bits))
    # one row per 2**30 ids: the only window here without a partition
    spans = blocks.groupBy("_span").agg(F.sum("_n").alias("_span_n"))
    spans = spans.select(
        "_span", F.coalesce(F.sum("_span_n").over(W.orderBy("_span").rowsBetween(*_BEFORE)), F.lit(0)).alias("_base")
    )
    inside = W.partitionBy("_span").orderBy("_block").rowsBetween(*_BEFORE)
    offsets = (
        blocks.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(spans, "_span")
        .select("_block", (F.col("_base") + F.col("_inside")).alias("_offset"))
    )
    ranked = rank_in_block(work, [], row_id, bits).join(offsets, "_block")
    position = (F.col("_offset") + F.col("_local") - 1).cast("bigint")
    return ranked.select(*[F.col(x).alias(c) for c, x in now.items()], position.alias(name))


def rank_rows(
    df: DataFrame, order: list[Column], name: str = "_rank", start: int = 1, partitions: int | None = None
) -> DataFrame:
    """Dense row number in any order: range shuffle, sort inside partitions, add up partition sizes.

    The order should be total (end it with a unique column); otherwise a run of
    equal rows stays in one partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place, part, offset = (unused(df.columns, c) for c in ("_placed", "_part", "_offset"))
    placed = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn(place, F.monotonically_increasing_id())
    )
    # sampled range bounds differ between runs, so both readers share one stage
    staged = stage(placed, "rank").withColumn(part, F.shiftright(place, MONOTONIC_BITS))
    sizes = staged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(
        part, F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(*_BEFORE)), F.lit(0)).alias(offset)
    )
    position = F.col(place).bitwiseAND(F.lit((1 << MONOTONIC_BITS) - 1))
    # at most n rows, n being the partition count chosen above
    ranked = staged.join(F.broadcast(offsets), part)
    return ranked.select(
        *[named(c) for c in df.columns],
        (F.col(offset) + position + F.lit(start)).cast("bigint").alias(name),
    )

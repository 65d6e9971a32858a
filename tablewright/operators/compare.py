"""Compare two tables on a key.

Rows of one key pair up by order of appearance: they meet on (key, n-th
occurrence), which is unique on both sides, so a key that holds a large share of
the rows is spread by its ordinals.

What is numbered and paired are narrow rows: key, row id and a 128-bit
fingerprint of the compared cells.  Equal fingerprints are equal rows; cells are
fetched, by row id, only for pairs that differ and for rows without a partner,
so what is shuffled falls with the share of rows that are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.names import bind, named
from tablewright.functions.text import key_parts, plain_text, ustrip
from tablewright.operators.identity import BLOCK_BITS, ROW_ID, block_of, fingerprint, rank_in_block
from tablewright.operators.schema import data_columns, order_columns, require_columns
from tablewright.operators.staging import stage


Types = dict[str, T.DataType]


def _types(df: DataFrame) -> Types:
    return {f.name: f.dataType for f in df.schema.fields}


def _text(cell: Column, dtype: T.DataType | None) -> Column:
    return F.lit("") if dtype is None else F.coalesce(ustrip(plain_text(cell, dtype)), F.lit(""))


def _by_value(left: T.DataType | None, right: T.DataType | None) -> bool:
    """Equal typed cells compare by value, everything else by trimmed text with null as ""."""
    return left == right and not isinstance(left, T.StringType)


def _narrow(df: DataFrame, keys: list[str], columns: list[str], others: Types, row_id: str) -> DataFrame:
    """(_key, _row_id, _p0, _p1): two rows of the tables compared have equal prints if all their cells compare equal."""
    own = _types(df)
    key = key_parts([plain_text(named(k), own[k]) for k in keys], "compare")
    cells = [
        (named(c), own[c]) if _by_value(own.get(c), others.get(c)) else (_text(named(c), own.get(c)), T.StringType())
        for c in columns
    ]
    prints = [p.alias(f"_p{i}") for i, p in enumerate(fingerprint(cells))]
    return df.select(key.alias("_key"), named(row_id).alias(ROW_ID), *prints)


def _numbered(rows: DataFrame) -> DataFrame:
    """``_ord``, ``_in_a`` and ``_in_b`` of rows whose keys have few rows each: one shuffle and one sort."""
    of_side = W.partitionBy("_hash", "_key", "_right").orderBy(ROW_ID)
    of_key = W.partitionBy("_hash", "_key")
    met = rows.repartition("_hash").withColumn("_ord", F.row_number().over(of_side).cast("bigint"))
    return met.select(
        *rows.columns,
        "_ord",
        F.count_if(~F.col("_right")).over(of_key).alias("_in_a"),
        F.count_if("_right").over(of_key).alias("_in_b"),
    )


def _numbered_in_blocks(rows: DataFrame, bits: int) -> DataFrame:
    """The same of keys with any number of rows.

    One count per (key, side, block) gives the offsets of the blocks and the
    totals of both sides.
    """
    by = ["_hash", "_key", "_right", "_block"]
    counts = rows.groupBy("_hash", "_key", "_right", block_of(F.col(ROW_ID), bits).alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    of_key = W.partitionBy("_hash", "_key")
    earlier = W.partitionBy("_hash", "_key", "_right").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = counts.select(
        *by,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.coalesce(F.sum(F.when(~F.col("_right"), F.col("_n"))).over(of_key), F.lit(0)).alias("_in_a"),
        F.coalesce(F.sum(F.when(F.col("_right"), F.col("_n"))).over(of_key), F.lit(0)).alias("_in_b"),
    )
    ranked = rank_in_block(rows, ["_hash", "_key", "_right"], ROW_ID, bits).join(blocks, by)
    return ranked.select(*rows.columns, (F.col("_local") + F.col("_offset")).cast("bigint").alias("_ord"), "_in_a", "_in_b")


def statuses(a: DataFrame, b: DataFrame, keys: list[str], row_id: str = ROW_ID, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per pair or unmatched row: ``_key``, ``_ord``, ``_status`` and the row ids ``_id_a`` and ``_id_b``.

    Both tables are numbered at once, and the n-th rows of the two sides meet in
    one aggregate.  Only keys with more rows than a sixteenth of a block (told by
    one count, written once) are numbered in blocks.
    """
    if not keys:
        raise ValueError("choose at least one key column")
    require_columns(a, keys, "key column of table A")
    require_columns(b, keys, "key column of table B")
    columns = compared_columns(a, b, keys, row_id)
    left = _narrow(a, keys, columns, _types(b), row_id).withColumn("_right", F.lit(False))
    right = _narrow(b, keys, columns, _types(a), row_id).withColumn("_right", F.lit(True))
    # keys are brought together and sorted by a number first: comparing their arrays costs many times as much
    rows = left.union(right).withColumn("_hash", F.xxhash64("_key"))
    many = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (1 << max(0, bits - 4)))
    many = stage(many.select("_hash"), "many-rows")
    if many.isEmpty():
        ranked = _numbered(rows)
    else:
        ranked = _numbered(rows.join(many, "_hash", "left_anti")).unionByName(_numbered_in_blocks(rows.join(many, "_hash", "left_semi"), bits))

    # at most one row of either side has a key's n-th place; numbers, so nothing is sorted
    def of_side(right: bool, column: str) -> Column:
        return F.max(F.when(F.col("_right") == right, F.col(column)))

    found = {f"{c}_{side}": of_side(side == "b", c) for c in (ROW_ID, "_p0", "_p1") for side in "ab"}
    totals = [F.max(c).alias(c) for c in ("_in_a", "_in_b")]
    paired = ranked.groupBy("_hash", "_key", "_ord").agg(*(c.alias(n) for n, c in found.items()), *totals)
    id_a, id_b = F.col(f"{ROW_ID}_a"), F.col(f"{ROW_ID}_b")
    equal = (F.col("_p0_a") == F.col("_p0_b")) & (F.col("_p1_a") == F.col("_p1_b"))
    status = (
        F.when(id_b.isNull(), F.when(F.col("_in_b") > 0, F.lit("only_a_surplus")).otherwise(F.lit("only_a")))
        .when(id_a.isNull(), F.when(F.col("_in_a") > 0, F.lit("only_b_surplus")).otherwise(F.lit("only_b")))
        .when(equal, F.lit("same"))
        .otherwise(F.lit("changed"))
    )
    return paired.select("_key", "_ord", status.alias("_status"), id_a.alias("_id_a"), id_b.alias("_id_b"))


def with_cells(pairs: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], row_id: str = ROW_ID) -> DataFrame:
    """Rows of ``statuses`` with ``changed_fields`` and every compared column twice, as ``<column>_A`` and ``<column>_B``."""
    types = {"_a": _types(a), "_b": _types(b)}
    columns = compared_columns(a, b, keys, row_id)
    # rows without a partner on a side go by their own id, not all to one task as nulls
    met = pairs.withColumn("_either", F.coalesce("_id_a", "_id_b"))
    for side, table in (("_a", a), ("_b", b)):
        cells = F.struct(*(named(c) for c in data_columns(table) if c != row_id)).alias(side)
        held = table.select(named(row_id).alias("_held"), cells)
        own = F.coalesce(f"_id{side}", "_either")
        met = met.join(held, (own == F.col("_held")) & F.col(f"_id{side}").isNotNull(), "left").drop("_held")

    def cell(side: str, name: str) -> Column:
        return F.col(side).getField(name) if name in types[side] else F.lit("")

    def differs(name: str) -> Column:
        x, y = cell("_a", name), cell("_b", name)
        left, right = types["_a"].get(name), types["_b"].get(name)
        return ~x.eqNullSafe(y) if _by_value(left, right) else _text(x, left) != _text(y, right)

    names = F.concat_ws("、", *(F.when(differs(c), F.lit(c)) for c in columns))
    flagged = bind(met, {"changed_fields": F.when(F.col("_status") == "changed", names)})
    return flagged.select(
        "_key",
        "_ord",
        "_status",
        "changed_fields",
        *[cell("_a", c).alias(f"{c}_A") for c in columns],
        *[cell("_b", c).alias(f"{c}_B") for c in columns],
    )


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], row_id: str = ROW_ID, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per pair or unmatched row.

    Columns: ``_key``, ``_ord``, ``_status``, ``changed_fields`` and every
    compared column twice, as ``<column>_A`` and ``<column>_B``.  Pairs that are
    the same have no changed fields and carry no cells.
    """
    pairs = statuses(a, b, keys, row_id, bits)
    different = with_cells(pairs.filter(F.col("_status") != "same"), a, b, keys, row_id)
    same = pairs.filter(F.col("_status") == "same").select("_key", "_ord", "_status", F.lit("").alias("changed_fields"))
    return different.unionByName(same, allowMissingColumns=True)


def compared_columns(a: DataFrame, b: DataFrame, keys: list[str], row_id: str = ROW_ID) -> list[str]:
    return [c for c in order_columns(data_columns(a), data_columns(b), keys) if c != row_id]


def summary_counts() -> list[Column]:
    """Rows of A and B, only in A, only in B, changed, same: aggregates over ``_status``."""

    def among(*statuses: str) -> Column:
        return F.count_if(F.col("_status").isin(*statuses))

    paired = ("changed", "same")
    return [
        among("only_a", "only_a_surplus", *paired).alias("rows_a"),
        among("only_b", "only_b_surplus", *paired).alias("rows_b"),
        among("only_a", "only_a_surplus").alias("only_a"),
        among("only_b", "only_b_surplus").alias("only_b"),
        among("changed").alias("changed"),
        among("same").alias("same"),
    ]


def compare_summary(compared: DataFrame) -> DataFrame:
    """One row of counts."""
    return compared.agg(*summary_counts())


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose key ``b`` does not have."""
    types_b = {f.name: f.dataType for f in b.schema.fields}
    types_a = {f.name: f.dataType for f in a.schema.fields}
    known = b.select(key_parts([plain_text(named(k), types_b[k]) for k in keys], "compare").alias("_key")).distinct()
    keyed = a.withColumn("_key", key_parts([plain_text(named(k), types_a[k]) for k in keys], "compare"))
    return keyed.join(known, "_key", "left_anti").drop("_key")


def _one_sided(compared: DataFrame, columns: list[str], side: str) -> DataFrame:
    wanted = (f"only_{side.lower()}", f"only_{side.lower()}_surplus")
    return compared.filter(F.col("_status").isin(*wanted)).select(
        "_key", "_ord", *[named(f"{c}_{side}").alias(c) for c in columns], "_status"
    )


def only_a(compared: DataFrame, columns: list[str]) -> DataFrame:
    return _one_sided(compared, columns, "A")


def only_b(compared: DataFrame, columns: list[str]) -> DataFrame:
    return _one_sided(compared, columns, "B")


def changed_rows(compared: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [named(f"{c}_{side}") for c in columns for side in ("A", "B")]
    return compared.filter(F.col("_status") == "changed").select("_key", "_ord", "_status", *pairs, "changed_fields")


def difference_list(compared: DataFrame, columns: list[str]) -> DataFrame:
    """Unmatched rows under their plain headers and changed pairs under _A / _B, in one table."""
    changed = F.col("_status") == "changed"
    types = {f.name: f.dataType for f in compared.schema.fields}

    def plain(c: str) -> Column:
        a, b = named(f"{c}_A"), named(f"{c}_B")
        if types[f"{c}_A"] != types[f"{c}_B"]:
            a, b = plain_text(a, types[f"{c}_A"]), plain_text(b, types[f"{c}_B"])
        return F.when(F.col("_status").startswith("only_a"), a).when(F.col("_status").startswith("only_b"), b)

    return compared.filter(F.col("_status") != "same").select(
        "_key",
        "_ord",
        "_status",
        *[plain(c).alias(c) for c in columns],
        *[F.when(changed, named(f"{c}_{s}")).alias(f"{c}_{s}") for c in columns for s in ("A", "B")],
        F.when(changed, F.col("changed_fields")).alias("changed_fields"),
    )


def sink_order() -> list[Column]:
    """Only in A, only in B, changed; whole-key misses before surplus rows; then key and ordinal.

    Section and key are one text, so that a sort tells most rows apart by the first bytes.
    """
    section = reduce(
        lambda c, pair: c.when(F.col("_status").startswith(pair[0]), F.lit(pair[1])),
        [("only_b", "1"), ("changed", "2")],
        F.when(F.col("_status").startswith("only_a"), F.lit("0")),
    )
    surplus = F.when(F.col("_status").endswith("_surplus"), F.lit("1")).otherwise(F.lit("0"))
    # a pair that is the same has no section and comes first
    return [F.concat(F.coalesce(section, F.lit("-")), surplus, F.array_join("_key", "||")), F.col("_ord")]

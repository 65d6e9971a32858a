"""Merge tables by column name and audit how their headers lined up.

Tables with the same header row are one scan (see ``sources.files.scan_many``),
so the plan grows with the number of distinct headers, not of files.  The
audits work on (source, column) counts, never on rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.constants import LABELS, SOURCE_COLUMN, SOURCE_COLUMN_TAKEN
from tablewright.functions.names import named
from tablewright.functions.text import is_blank, plain_text
from tablewright.operators.identity import ROW_ID
from tablewright.operators.schema import align_headers, data_columns, normalize_header

SOURCE = "_source_file"
ORDER = "_source_order"


@dataclass(frozen=True)
class HeaderGroup:
    """Rows of all sources that share one header row.

    ``rows`` carries the source in ``_source_file`` and its place in
    ``_source_order``; ``headers`` are the headers as they stand in the sources.
    """

    rows: DataFrame
    headers: tuple[str, ...]
    sources: tuple[tuple[int, str], ...]

    def aligned(self, aliases: dict[str, str] | None = None) -> list[str]:
        return align_headers(list(self.headers), aliases)


def named_table(df: DataFrame, name: str, order: int) -> HeaderGroup:
    """Wrap a DataFrame as one source."""
    rows = df.withColumns({SOURCE: F.lit(name), ORDER: F.lit(order)})
    return HeaderGroup(rows, tuple(data_columns(df)), ((order, name),))


def _aligned_rows(group: HeaderGroup, add_source: bool, aliases: dict[str, str] | None) -> DataFrame:
    before = data_columns(group.rows)
    after = group.aligned(aliases)
    if add_source:
        after = [SOURCE_COLUMN_TAKEN if c == SOURCE_COLUMN else c for c in after]
    place = [F.col(ROW_ID)] if ROW_ID in group.rows.columns else []
    return group.rows.select(F.col(SOURCE), F.col(ORDER), *place, *[named(b).alias(a) for b, a in zip(before, after)])


def merged_columns(
    groups: list[HeaderGroup], add_source: bool = True, aliases: dict[str, str] | None = None
) -> list[str]:
    """Aligned columns in the order they are first seen (sources in their order)."""
    by_first_source = sorted(groups, key=lambda g: min(g.sources))
    seen: dict[str, None] = {}
    for group in by_first_source:
        for column in group.aligned(aliases):
            seen[SOURCE_COLUMN_TAKEN if add_source and column == SOURCE_COLUMN else column] = None
    return list(seen)


def widened(types: set[T.DataType], exact: bool = True) -> T.DataType:
    """The narrowest type that holds the values of all; text where there is none.

    Doubles hold whole numbers and decimals of up to 15 digits.  ``exact`` tells
    whether those of longer types survive as doubles; where they don't, text does.
    """
    if len(types) == 1:
        return next(iter(types))
    if all(isinstance(t, T.IntegralType) for t in types):
        return max(types, key=lambda t: ("tinyint", "smallint", "int", "bigint").index(t.simpleString()))
    if all(isinstance(t, (T.IntegralType, T.DecimalType)) for t in types):
        scale = max(t.scale for t in types if isinstance(t, T.DecimalType))
        whole = max(t.precision - t.scale if isinstance(t, T.DecimalType) else 19 for t in types)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType() if exact else T.StringType()
    if all(isinstance(t, (T.DateType, T.TimestampType)) for t in types):
        return T.TimestampType()
    return T.StringType()


def _may_round(dtype: T.DataType) -> bool:
    """Whether a double may hold a value of this type only roughly."""
    return isinstance(dtype, T.LongType) or isinstance(dtype, T.DecimalType) and dtype.precision > 15


def _rounds(c: Column, dtype: T.DataType) -> Column:
    """Whether a value is another one after a turn as a double."""
    as_double = c.cast("double")
    changed = ~c.eqNullSafe(as_double.try_cast(dtype))
    # the largest long comes back from 2**63 by saturation
    return changed | F.coalesce(as_double >= 2.0**63, F.lit(False)) if isinstance(dtype, T.LongType) else changed


def _rounded_as_double(frames: list[DataFrame], held: dict[str, set]) -> set[str]:
    """Columns that would be doubles, of which one source has a value that no double equals.

    Only sources with a long type of such a column are read, and of them only
    these columns; each gives one row of flags.
    """
    mixed = {n for n, types in held.items() if len(types) > 1 and isinstance(widened(types), T.DoubleType)}
    checks = []
    for frame in frames:
        doubtful = [f for f in frame.schema.fields if f.name in mixed and _may_round(f.dataType)]
        if doubtful:
            flags = [F.max(_rounds(named(f.name), f.dataType)) for f in doubtful]
            found = F.array(*[F.when(flag, F.lit(f.name)) for flag, f in zip(flags, doubtful)])
            checks.append(frame.agg(F.array_compact(found).alias("rounded")))
    if not checks:
        return set()
    return {name for row in reduce(lambda a, b: a.union(b), checks).collect() for name in row["rounded"]}


def _common_types(frames: list[DataFrame]) -> dict[str, T.DataType]:
    """Type of every column: its own where all sources agree, else a wider one that rounds no value."""
    held: dict[str, set] = {}
    for frame in frames:
        for field in frame.schema.fields:
            held.setdefault(field.name, set()).add(field.dataType)
    rounded = _rounded_as_double(frames, held)
    return {n: widened(t, n not in rounded) for n, t in held.items()}


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    types = _common_types(frames)

    def agree(frame: DataFrame) -> DataFrame:
        return frame.select(
            *[
                named(f.name)
                if f.dataType == types[f.name]
                else (
                    plain_text(named(f.name), f.dataType)
                    if isinstance(types[f.name], T.StringType)
                    else named(f.name).cast(types[f.name])
                ).alias(f.name)
                for f in frame.schema.fields
            ]
        )

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [agree(f) for f in frames])


def merge_tables(
    groups: list[HeaderGroup], add_source: bool = True, aliases: dict[str, str] | None = None, audit: bool = False
) -> DataFrame:
    """All rows under common headers, the source file first.

    Where every source has row ids they stay, as ``_row_id``: sources in their
    order, rows as they stand in them.  With ``audit`` the bookkeeping columns
    ``_source_file`` and ``_source_order`` stay, for the reports below.

    Where whole numbers of 64 bits or long decimals meet doubles under one header,
    those columns are looked through first: the column is text if a double would
    round one of them.
    """
    if not groups:
        raise ValueError("none of the tables has data to merge")
    merged = union_by_name([_aligned_rows(g, add_source, aliases) for g in groups])
    columns = [named(c) for c in merged_columns(groups, add_source, aliases)]
    if add_source:
        columns.insert(0, F.col(SOURCE).alias(SOURCE_COLUMN))
    if audit:
        columns += [F.col(SOURCE), F.col(ORDER)]
    if all(ROW_ID in g.rows.columns for g in groups):
        columns.append(F.col(ROW_ID))
    return merged.select(*columns)


def _columns_table(groups: list[HeaderGroup], add_source: bool, aliases: dict[str, str] | None) -> list[str]:
    return [c for c in merged_columns(groups, add_source, aliases) if c != SOURCE_COLUMN]


def fill_note(rows: Column, filled: Column, present: Column) -> Column:
    return (
        F.when(~present, F.lit("absent"))
        .when(filled == rows, F.lit("normal"))
        .when(filled == 0, F.lit("all_empty"))
        .otherwise(F.lit("partly_empty"))
    )


def null_stats(
    groups: list[HeaderGroup], add_source: bool = True, aliases: dict[str, str] | None = None
) -> DataFrame:
    """One row per source and merged column: rows, filled, empty and a note."""
    columns = _columns_table(groups, add_source, aliases)
    parts = []
    for group in groups:
        rows = _aligned_rows(group, add_source, aliases)
        types = {f.name: f.dataType for f in rows.schema.fields}
        counted = rows.groupBy(ORDER, SOURCE).agg(
            F.count(F.lit(1)).alias("rows"),
            *[
                F.count_if(~is_blank(plain_text(named(c), types[c]), "merge")).alias(f"f{i}")
                for i, c in enumerate(columns)
                if c in types
            ],
        )
        cells = [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(i).alias("position"),
                (F.col(f"f{i}") if c in types else F.lit(0).cast("bigint")).alias("filled"),
                F.lit(c in types).alias("present"),
            )
            for i, c in enumerate(columns)
        ]
        parts.append(counted.select(ORDER, SOURCE, "rows", F.inline(F.array(*cells))))
    stats = reduce(lambda a, b: a.unionByName(b), parts)
    return stats.select(
        F.col(ORDER).alias("source_order"),
        F.col(SOURCE).alias("file"),
        "column",
        "position",
        "rows",
        "filled",
        (F.col("rows") - F.col("filled")).alias("empty"),
        fill_note(F.col("rows"), F.col("filled"), F.col("present")).alias("note"),
    )


def _fill_patterns(stats: DataFrame) -> DataFrame:
    """Columns filled in only some sources, each with its group and the group that complements it.

    The sources a column is filled in are told by 128 bits, the XOR of their hashes, and so are those it
    is not filled in; columns meet under the lesser of both, so no list of sources is ever a key.
    """
    has = F.col("filled") > 0
    marks = [F.xxhash64("source_order", F.lit(seed)) for seed in (0, 1)]

    def signature(which) -> Column:
        return F.concat_ws(":", *[F.lpad(F.hex(F.bit_xor(F.when(which, m))), 16, "0") for m in marks])

    columns = stats.groupBy("column", "position").agg(
        F.count_if(has).alias("filled_sources"),
        F.count_if(~has).alias("missing_sources"),
        signature(has).alias("inside"),
        signature(~has).alias("outside"),
        F.sort_array(F.collect_set(F.when(~has, F.col("file")))).alias("names"),
    )
    partial = columns.filter((F.col("filled_sources") > 0) & (F.col("missing_sources") > 0))
    lesser = F.col("inside") < F.col("outside")
    both = W.partitionBy(F.least("inside", "outside"))
    place = F.struct("position", "column")
    one, other = F.min(F.when(lesser, place)).over(both)["column"], F.min(F.when(~lesser, place)).over(both)["column"]
    return partial.withColumns(
        {"group": F.when(lesser, one).otherwise(other), "twin_group": F.when(lesser, other).otherwise(one)}
    )


def alignment_groups(stats: DataFrame) -> DataFrame:
    """One row per column filled in only some sources: column, position, group, twin_group, filled_sources, missing_sources.

    Columns of one ``group`` (named by its first column) are filled in the same sources; those of its
    ``twin_group`` are filled exactly in the others (null: there are none), so any two columns across the
    two look like one field under two names.  The table has a row per column, however many pairs that is.
    An empty table of counts, or one source alone, gives no rows.
    """
    return _fill_patterns(stats).select("column", "position", "group", "twin_group", "filled_sources", "missing_sources")


def alignment_warnings(stats: DataFrame) -> DataFrame:
    """Columns filled in only some sources, and pairs that look like one field under two names.

    A pair is reported when one column is filled exactly in the sources where the other is not: the
    columns of a group of ``alignment_groups`` and those of its twin, written out for the report.
    """
    partial = _fill_patterns(stats)
    some = partial.select(
        F.lit("partly_filled").alias("kind"),
        "column",
        F.lit(None).cast("string").alias("other_column"),
        F.array_join("names", "、").alias("missing_in"),
    )
    first = partial.select("column", F.col("position").alias("p1"), "group")
    second = partial.select(F.col("column").alias("other"), F.col("position").alias("p2"), F.col("twin_group").alias("group"))
    pairs = first.join(second, "group").filter(F.col("p1") < F.col("p2"))
    twins = pairs.select(
        F.lit("same_field").alias("kind"),
        "column",
        F.col("other").alias("other_column"),
        F.lit(None).cast("string").alias("missing_in"),
    )
    return some.unionByName(twins)


def warning_text(warnings: DataFrame) -> DataFrame:
    some = F.format_string("列「%s」在这些来源里没有内容：%s", F.col("column"), F.col("missing_in"))
    twin = F.format_string("列「%s」与列「%s」从不同时有内容，请核对是否同一字段", F.col("column"), F.col("other_column"))
    return warnings.withColumn("message", F.when(F.col("kind") == "partly_filled", some).otherwise(twin))


def header_matrix(
    groups: list[HeaderGroup], stats: DataFrame, aliases: dict[str, str] | None = None
) -> DataFrame:
    """Merged column by source: the header the source has for it, or that it has none."""
    rows = []
    for g, group in enumerate(groups):
        for before, after in zip(map(normalize_header, group.headers), group.aligned(aliases)):
            rows.append((g, after, before if before == after else f"{before}→{after}"))
    spark = stats.sparkSession
    members = [(order, g) for g, group in enumerate(groups) for order, _ in group.sources]
    labels = spark.createDataFrame(rows, "grp int, column string, label string")
    member_of = spark.createDataFrame(members, "source_order int, grp int")
    cells = (
        stats.select("column", "position", "source_order", "file")
        .join(member_of, "source_order")
        .join(labels, ["grp", "column"], "left")
    )
    return cells.select(
        "column",
        "position",
        "source_order",
        "file",
        F.coalesce("label", F.lit(LABELS["absent_header"])).alias("header"),
    )


def merge_summary(stats: DataFrame, warnings: DataFrame, add_source: bool = True) -> DataFrame:
    """One row: files, rows, columns (the source column included) and warnings."""
    per_file = stats.groupBy("source_order").agg(
        F.max("rows").alias("rows"), F.max("position").alias("last"), F.lit(0).alias("warned")
    )
    warned = warnings.select(
        F.lit(None).cast("int").alias("source_order"),
        F.lit(0).cast("bigint").alias("rows"),
        F.lit(None).cast("int").alias("last"),
        F.lit(1).alias("warned"),
    )
    return per_file.unionByName(warned).agg(
        F.count("source_order").alias("files"),
        F.sum("rows").alias("rows"),
        (F.max("last") + (2 if add_source else 1)).cast("bigint").alias("columns"),
        F.sum("warned").alias("warnings"),
    )

"""Blank rows, full duplicates and keyed duplicates, with the removed rows kept.

Which rows stay is decided on narrow rows: a 128-bit fingerprint of all columns,
the key and the row id.  Counts, minima and maxima of them are combined on the
map side, so neither a group of copies nor a popular key meets in one task.
Only groups that lose a row are handed back to the table; where they are few
they are broadcast, by Spark's size check, and the table is not shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.dates import latest_key
from tablewright.functions.names import bind, named, option, unused
from tablewright.functions.text import dedupe_key, plain_text
from tablewright.operators.identity import ROW_ID, fingerprint
from tablewright.operators.schema import blank_row, data_columns, require_columns
from tablewright.operators.staging import stage

REASON = "_removed_reason"
KEEP_MODES = ("first", "last", "latest")


def _reason_so_far(df: DataFrame) -> Column:
    return F.col(REASON) if REASON in df.columns else F.lit(None).cast("string")


def mark_blank_rows(df: DataFrame) -> DataFrame:
    """Set ``_removed_reason`` to ``blank_row`` on rows without any content."""
    found = F.when(blank_row(df), F.lit("blank_row"))
    kept = [named(c) for c in df.columns if c != REASON]
    return df.select(*kept, F.coalesce(_reason_so_far(df), found).alias(REASON))


def keep_mode(keep: str | None) -> str:
    """Which copy of a key stays; anything unknown means the first."""
    return option(keep, KEEP_MODES) or KEEP_MODES[0]


def recency(df: DataFrame, column: str, unparseable: str = "text") -> Column:
    return latest_key(named(column), df.schema[column].dataType, unparseable)


def mark_duplicates(
    df: DataFrame,
    full: bool = False,
    key_columns: list[str] | None = None,
    keep: str = "first",
    latest_column: str | None = None,
    unparseable: str = "text",
    row_id: str = ROW_ID,
    staged: bool = False,
) -> DataFrame:
    """Set ``_removed_reason`` to ``full_duplicate`` or ``key_duplicate``.

    Full duplicates go first and keep the first copy; keyed duplicates are then
    decided among what is left.  Rows that already have a reason, and rows whose
    key is blank in every part, take no part.  With ``staged`` the groups that
    lose a row are written, for results that are read several times.
    """
    keys = list(key_columns or [])
    mode = keep_mode(keep)
    if keys:
        require_columns(df, keys, "dedupe column")
        if mode == "latest":
            require_columns(df, [latest_column], "date column for keeping the latest row")
    before = _reason_so_far(df)
    out = [named(c) for c in df.columns if c != REASON]
    if not full and not keys:
        return df.select(*out, before.alias(REASON))
    types = {f.name: f.dataType for f in df.schema.fields}
    # copies have equal keys and dates, so a group of them is known by its fingerprint
    group = fingerprint([(named(c), types[c]) for c in data_columns(df)]) if full else []
    key = dedupe_key([plain_text(named(c), types[c]) for c in keys]) if keys else F.lit(None).cast("array<string>")
    age = recency(df, latest_column, unparseable) if keys and mode == "latest" else F.lit("")
    added = {"live": before.isNull(), **{f"print{i}": c for i, c in enumerate(group)}, "key": key}
    names = {c: unused(df.columns, f"_{c}") for c in added}
    marked = bind(df, {names[c]: value for c, value in added.items()})
    prints = [F.col(names[f"print{i}"]).alias(f"p{i}") for i in range(len(group))]
    live = F.col(names["live"])
    narrow = marked.where(live).select(*prints, F.col(names["key"]).alias("k"), age.alias("age"), named(row_id).alias("id"))

    def best(rows: DataFrame) -> DataFrame:
        """Which row of a key stays; keys of one row lose none."""
        wanted = {"first": F.min("id"), "last": F.max("id"), "latest": F.max(F.struct("age", "id"))["id"]}[mode]
        found = rows.where("k IS NOT NULL").groupBy("k").agg(wanted.alias("best"), F.count(F.lit(1)).alias("rows"))
        return found.where("rows > 1").select("k", "best")

    if full:
        by = [f"p{i}" for i in range(len(group))]
        copies = narrow.groupBy(*by).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in (("k", "age") if keys else ())))
        if keys:
            won = best(copies)
            copies = copies.join(won, "k", "left").withColumn("lost", F.coalesce(F.col("id") != F.col("best"), F.lit(False)))
        else:
            copies = copies.withColumn("lost", F.lit(False))
        losing = copies.where("rows > 1 OR lost").select(*by, F.col("id").alias("first"), "lost")
        decided = losing.select(*(F.col(c).alias(unused(marked.columns, f"_{c}")) for c in by), *(F.col(c).alias(unused(marked.columns, f"_{c}")) for c in ("first", "lost")))
        *own, first, lost = decided.columns
        same = reduce(lambda x, y: x & y, (F.col(p) == F.col(names[f"print{i}"]) for i, p in enumerate(own)))
        reason = F.when(named(row_id) != F.col(first), "full_duplicate").when(F.col(lost), "key_duplicate")
    else:
        theirs, stays = (unused(marked.columns, c) for c in ("_theirs", "_stays"))
        decided = best(narrow).toDF(theirs, stays)
        same = F.col(names["key"]) == F.col(theirs)
        reason = F.when(named(row_id) != F.col(stays), "key_duplicate")
    joined = marked.join(stage(decided, "losing") if staged else decided, same & live, "left")
    return joined.select(*out, F.coalesce(before, reason).alias(REASON))


def split_kept_removed(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed rows with their reason first)."""
    rest = [named(c) for c in marked.columns if c != REASON]
    kept = marked.filter(F.col(REASON).isNull()).select(*rest)
    removed = marked.filter(F.col(REASON).isNotNull()).select(REASON, *rest)
    return kept, removed

"""Column builders for date cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import is_blank, repair, ustrip

YEAR = r"((?!0000)\d{4})"
MONTH = r"(1[0-2]|0[1-9]|[1-9])"
DAY = r"(3[0-1]|[1-2]\d|0[1-9]|[1-9]| [1-9])"
CLOCK = r"(?:2[0-3]|[0-1]\d|\d):(?:[0-5]\d|\d):(?:[0-5]\d|\d)"
GAP = r"[-/\s\x1c-\x1f]"

# Readings that name their fields, as one alternation.  The month comes first in
# slashed dates, and day first only where that reading cannot be a month.
SHAPES = (
    rf"{YEAR}([-/]){MONTH}\2{DAY}(?:\s+{CLOCK})?",
    rf"{YEAR}\.{MONTH}\.{DAY}",
    rf"{YEAR}{MONTH}{DAY}",
    rf"{YEAR}年{MONTH}月{DAY}日",
    rf"{MONTH}/{DAY}/{YEAR}",
    rf"{DAY}/{MONTH}/{YEAR}",
)
NAMED_DATE = rf"(?U)^(?:{'|'.join(SHAPES)})\z"
# groups left out by the alternative that matched are empty
NAMED_FIELDS = "$1$5$8$11$16$19-$3$6$9$12$14$18-$4$7$10$13$15$17"
# last resort: year, month and day split by any separators, anything after them ignored
LOOSE_DATE = rf"(?U)^{GAP}*{YEAR}{GAP}+\+?0*(\d{{1,2}}){GAP}+\+?0*(\d{{1,2}})(?:{GAP}.*)?\z"


# what a sink shows as a day: no time, midnight, or a zero time further back
SHOWN_DAY = (
    rf"(?Us)^{YEAR}([-/]){MONTH}\2{DAY}(?:\s+00?:00?:00?| (?:.* )?00?:00:00.*)?\z"
)
SHOWN_MOMENT = rf"(?U)^{YEAR}([-/]){MONTH}\2{DAY}\s+({CLOCK})\z"


def parse_date(c: Column, dtype: T.DataType | None = None) -> Column:
    """Date of a cell or null."""
    dtype = dtype or T.StringType()
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    raw = ustrip(c if isinstance(dtype, T.StringType) else c.cast("string"))
    loose = F.translate(raw, "年月./０１２３４５６７８９日", "----0123456789")
    fields = F.when(raw.rlike(NAMED_DATE), F.regexp_replace(raw, NAMED_DATE, NAMED_FIELDS)).when(
        loose.rlike(LOOSE_DATE), F.regexp_replace(loose, LOOSE_DATE, "$1-$2-$3")
    )
    return F.try_to_date(F.replace(fields, F.lit(" "), F.lit("")), "yyyy-M-d")


def iso_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def fix_date(c: Column, parsed: Column, dtype: T.DataType | None = None) -> Column:
    """struct<value, fixed, problem>; the value is ISO text whenever the cell parses.

    Typed dates, and text that only needs trimming, are rewritten without
    counting as fixed.
    """
    dtype = dtype or T.StringType()
    if not isinstance(dtype, T.StringType):
        return F.struct(
            iso_text(parsed).alias("value"), F.lit(False).alias("fixed"), F.lit(None).cast("string").alias("problem")
        )
    base = repair(c, iso_text(parsed), parsed.isNotNull(), "bad_date")
    return base.withField("value", F.coalesce(iso_text(parsed), c))


def date_cell(c: Column, dtype: T.DataType | None = None) -> Column:
    """Cell as written to a result: dates and midnight timestamps as ``YYYY-MM-DD`` text."""
    dtype = dtype or T.StringType()
    if isinstance(dtype, T.DateType):
        return iso_text(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        midnight = c == F.date_trunc("day", c)
        return F.when(midnight, iso_text(c)).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    if not isinstance(dtype, T.StringType):
        return c
    text = ustrip(c)
    day = F.try_to_date(F.replace(F.regexp_replace(text, SHOWN_DAY, "$1-$3-$4"), F.lit(" "), F.lit("")), "yyyy-M-d")
    moment = F.try_to_timestamp(
        F.replace(F.regexp_replace(text, SHOWN_MOMENT, "$1-$3-$4T$5"), F.lit(" "), F.lit("")),
        F.lit("yyyy-M-d'T'H:m:s"),
    )
    shown = F.when(text.rlike(SHOWN_DAY), iso_text(day)).when(
        text.rlike(SHOWN_MOMENT), F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
    )
    return F.coalesce(shown, F.when(text != "", c))


def month_key(c: Column, dtype: T.DataType | None = None) -> Column:
    return F.date_format(parse_date(c, dtype), "yyyy-MM")


def latest_key(c: Column, dtype: T.DataType | None = None, unparseable: str = "text") -> Column:
    """Text that sorts like the recency of a cell: blank < everything else.

    A cell that is no date sorts by its text among the ISO dates; with
    ``unparseable="oldest"`` it counts as blank instead.
    """
    dtype = dtype or T.StringType()
    parsed = iso_text(parse_date(c, dtype))
    if not isinstance(dtype, T.StringType):
        filled = parsed if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else c.cast("string")
        return F.coalesce(F.concat(F.lit("1"), filled), F.lit("0"))
    rest = F.lit(None) if unparseable == "oldest" else F.when(~is_blank(c), ustrip(c))
    return F.coalesce(F.concat(F.lit("1"), F.coalesce(parsed, rest)), F.lit("0"))

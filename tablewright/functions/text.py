"""Column builders for text cells.  All of them are native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.constants import (
    BLANK_BUCKET,
    BLANK_TOKENS,
    EMAIL_PATTERN,
    NAME_CHARACTER,
    PHONE_PATTERN,
    WHITESPACE,
)

#: whole doubles from here on have more digits than a decimal holds and keep their exponent
LONGEST_WHOLE = 2.0**125

SPACE = r"[\s\x1c-\x1f]"
NUMERIC_TEXT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
SCIENTIFIC_TEXT = r"^[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]\d+\z"
INTEGRAL_POINT_ZERO = r"^(?:\d+-?\d*|-\d+)\.0\z"


def ustrip(c: Column) -> Column:
    """Strip Unicode white space; ``trim`` alone only knows U+0020."""
    return F.btrim(c, F.lit(WHITESPACE))


def plain_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a typed cell as a spreadsheet user would type it (null stays null)."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(None)).otherwise(_double_text(c))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def _double_text(c: Column) -> Column:
    d = c.cast("double")
    text = d.cast("string")
    # 38 digits hold every double in [1e-4, 1e16) written out without exponent
    written_out = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    written_out = F.when(written_out.endswith("."), F.concat(written_out, F.lit("0"))).otherwise(written_out)
    small = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E-(\d)$", "e-0$1")
    small = F.regexp_replace(F.regexp_replace(small, "E-", "e-"), r"E(\d+)$", "e+$1")
    plain_range = (F.abs(d) >= 1e-4) & (F.abs(d) < 1e16) | (d == 0)
    return F.when(~text.contains("E"), text).when(plain_range, written_out).otherwise(small)


def is_blank(c: Column, mode: str = "clean") -> Column:
    """Never null.  ``mode`` picks one of the four meanings of blank."""
    tokens = [t for t in BLANK_TOKENS[mode] if t]
    if not BLANK_TOKENS[mode]:
        return c.isNull()
    return F.coalesce(c.rlike(rf"(?iU)^{SPACE}*(?:{'|'.join(tokens)})?{SPACE}*\z"), F.lit(True))


def digits(c: Column) -> Column:
    """Digits of a cell; the tokens that mean blank hold none."""
    return F.regexp_replace(c, r"(?U)\D", "")


# The tests below look at the untrimmed cell: each reads it once, which keeps
# expressions built on them small.


def looks_like_phone(c: Column) -> Column:
    """At least ten digits, the first of them a 1."""
    return c.rlike(r"(?U)^\D*1(?:\D*\d){9}")


def looks_like_email(c: Column) -> Column:
    return c.contains("@") & c.contains(".")


def is_written_name(c: Column) -> Column:
    """Two to eight Chinese characters, spaces between them allowed."""
    return c.rlike(rf"(?U)^{SPACE}*{NAME_CHARACTER}(?: *{NAME_CHARACTER}){{1,7}}{SPACE}*\z")


def looks_like_chinese_name(c: Column) -> Column:
    return is_written_name(c) & ~looks_like_phone(c) & ~looks_like_email(c)


def classify_contact(c: Column) -> Column:
    """blank, phone, email, name or unknown; the first that fits wins."""
    return (
        F.when(is_blank(c), F.lit("blank"))
        .when(looks_like_phone(c), F.lit("phone"))
        .when(looks_like_email(c), F.lit("email"))
        .when(is_written_name(c), F.lit("name"))
        .otherwise(F.lit("unknown"))
    )


def repair(c: Column, candidate: Column, valid: Column, problem: str) -> Column:
    """struct<value, fixed, problem>: take ``candidate`` when ``valid``, else keep and report.

    ``valid`` must be false for blank cells.
    """
    fixed = F.coalesce(valid & (candidate != ustrip(c)), F.lit(False))
    return F.struct(
        F.when(fixed, candidate).otherwise(c).alias("value"),
        fixed.alias("fixed"),
        F.when(~F.coalesce(valid, F.lit(False)) & ~is_blank(c), F.lit(problem)).alias("problem"),
    )


def fix_phone(c: Column) -> Column:
    only = digits(c)
    return repair(c, only, only.rlike(PHONE_PATTERN), "invalid_phone")


def fix_email(c: Column) -> Column:
    text = F.replace(F.lower(ustrip(c)), F.lit(" "), F.lit(""))
    return repair(c, text, text.rlike(EMAIL_PATTERN), "invalid_email")


def text_cell(c: Column, dtype: T.DataType | None = None) -> Column:
    """Identifier cell as text: no exponent, no trailing ``.0``, blank becomes null."""
    dtype = dtype or T.StringType()
    if isinstance(dtype, T.BooleanType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        finite = ~F.isnan(d) & (F.abs(d) < LONGEST_WHOLE)
        return F.when(F.isnan(d), F.lit(None)).when(
            finite & (d == F.rint(d)), _whole_number_text(d)
        ).otherwise(plain_text(c, dtype))
    if not isinstance(dtype, T.StringType):
        return plain_text(c, dtype)
    text = ustrip(c)
    number = F.when(text.rlike(SCIENTIFIC_TEXT), text.try_cast("double"))
    whole = number.isNotNull() & (number == F.rint(number)) & (F.abs(number) < LONGEST_WHOLE)
    return (
        F.when(is_blank(c), F.lit(None))
        .when(whole, _whole_number_text(number))
        .when(text.rlike(INTEGRAL_POINT_ZERO), F.substring(text, F.lit(1), F.length(text) - 2))
        .otherwise(text)
    )


def _whole_number_text(d: Column) -> Column:
    """All digits of a whole double under ``LONGEST_WHOLE``; a cast to decimal would round them to the shortest that tell it apart."""
    exact = d.try_cast("bigint").cast("string")
    # a double is a whole number of 61 bits times a power of two, and powers of two divide it exactly
    power = F.greatest(F.floor(F.log2(F.abs(d))) - 60, F.lit(0))
    scale = F.pow(F.lit(2.0), power)
    bits = (d / scale).try_cast("bigint").cast("decimal(19,0)")
    return F.when(F.abs(d) < 9e18, exact).otherwise((bits * _power_of_two(power)).cast("string"))


def _power_of_two(power: Column) -> Column:
    """2 to the power, at most 64, as a decimal of 20 digits."""
    half = F.least(power, F.lit(62))
    low, high = (F.pow(F.lit(2.0), x).cast("bigint") for x in (half, power - half))
    return low.cast("decimal(19,0)") * high.cast("decimal(1,0)")


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Amount cell as a number, 0 when it is not one.  Numeric columns keep their type."""
    dtype = dtype or T.StringType()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c, F.lit(0).cast(dtype))
    text = ustrip(F.translate(plain_text(c, dtype), ",￥¥元", ""))
    # the pattern keeps out spellings only the cast knows, such as "1d"
    parsed = F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))
    return F.coalesce(parsed, F.lit(0.0))


def key_parts(columns: list[Column], mode: str) -> Column:
    """Composite key as an array, so that no separator inside a cell can join two keys."""
    return F.array(*[F.when(is_blank(c, mode), F.lit("")).otherwise(ustrip(c)) for c in columns])


def key_text(columns: list[Column]) -> Column:
    """Display form of a compare key."""
    return F.array_join(key_parts(columns, "compare"), "||")


def dedupe_key(columns: list[Column]) -> Column:
    """Key array, null when every part is blank (such rows never count as duplicates)."""
    all_blank = reduce(lambda a, b: a & b, [is_blank(c) for c in columns])
    return F.when(~all_blank, key_parts(columns, "clean"))


def safe_label(c: Column, fallback: str = BLANK_BUCKET) -> Column:
    """Label usable as a file name."""
    text = F.when(is_blank(c, "split"), F.lit(fallback)).otherwise(ustrip(c))
    text = F.regexp_replace(F.translate(text, r'\/:*?"<>|', "_" * 9), r"(?U)[\s\x1c-\x1f]+", " ")
    cut = F.substring(F.btrim(text, F.lit(" .")), 1, 80)
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def label_text(code: Column, labels: dict[str, str]) -> Column:
    """Replace codes by report wording; unknown codes stay."""
    pairs = [F.lit(v) for item in labels.items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), code)

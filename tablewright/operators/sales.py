"""Totals per person, product and month.

Sums are partial on the map side; only aggregated groups are shuffled and
ranked.  Numeric amount columns keep their type, so integer or decimal amounts
add up exactly and independently of the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import month_key
from tablewright.functions.names import named
from tablewright.functions.text import NUMERIC_TEXT, is_blank, plain_text, to_number, ustrip
from tablewright.operators.identity import rank_rows
from tablewright.operators.schema import SalesRoles, require_columns


def sales_rows(df: DataFrame, roles: SalesRoles) -> DataFrame:
    """person, product, month, amount and qty of every row; qty is 1 per row without a qty column."""
    require_columns(df, [roles.person], "person column")
    require_columns(df, [roles.amount], "amount column")
    types = {f.name: f.dataType for f in df.schema.fields}

    def present(name: str | None) -> bool:
        return bool(name) and name in types

    columns = [named(roles.person).alias("person")]
    if present(roles.product):
        columns.append(named(roles.product).alias("product"))
    if present(roles.date):
        columns.append(month_key(named(roles.date), types[roles.date]).alias("month"))
    amount = to_number(named(roles.amount), types[roles.amount])
    qty = to_number(named(roles.qty), types[roles.qty]) if present(roles.qty) else F.lit(1).cast("bigint")
    return df.select(*columns, amount.alias("amount"), qty.alias("qty"))


def totals_by(rows: DataFrame, key: str) -> DataFrame:
    """Sum of amount and qty per key; a null key is a group of its own."""
    return rows.groupBy(key).agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"))


def sales_by_person(rows: DataFrame) -> DataFrame:
    """Totals per person, ranked 1..n by amount (ties by name)."""
    order = [F.col("amount").desc(), F.col("person").asc_nulls_last()]
    return rank_rows(totals_by(rows, "person"), order, "rank")


def sales_by_product(rows: DataFrame) -> DataFrame:
    if "product" not in rows.columns:
        return _empty(rows, "product")
    return totals_by(rows, "product").orderBy(F.col("amount").desc(), F.col("product").asc_nulls_last())


def sales_by_month(rows: DataFrame) -> DataFrame:
    """Totals per ``YYYY-MM`` over the rows whose date parses."""
    if "month" not in rows.columns:
        return _empty(rows, "month")
    return totals_by(valid_month(rows), "month").orderBy("month")


def valid_month(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("month").isNotNull())


def coerced_amounts(df: DataFrame, amount: str) -> DataFrame:
    """One row: how many filled amount cells are not numbers and therefore count as 0."""
    dtype = df.schema[amount].dataType
    text = plain_text(named(amount), dtype)
    if isinstance(dtype, T.NumericType):
        coerced = F.lit(False)
    else:
        coerced = ~is_blank(text) & ~ustrip(F.translate(text, ",￥¥元", "")).rlike(NUMERIC_TEXT)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(coerced).alias("coerced_to_zero"))


def _empty(rows: DataFrame, key: str) -> DataFrame:
    amount, qty = rows.schema["amount"], rows.schema["qty"]
    schema = T.StructType([T.StructField(key, T.StringType()), amount, qty])
    return rows.sparkSession.createDataFrame([], schema)

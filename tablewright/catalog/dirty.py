"""Untidy tables derived from the given ones.

The projections are SQL text that Spark and the checking engine both run, so
that the two sides start from the same cells.  Every source row is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.identity import spread

# customer -> k: the customer a row describes (every tenth row repeats its
# neighbour), p: whose phone it carries, v: which kind of mess it is
PERSON_KEYS = (
    "c_custkey AS _row_id",
    "CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey END AS k",
    "CASE WHEN c_custkey % 10 = 7 THEN c_custkey - 2 WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey END AS p",
    "(CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey END) % 17 AS v",
)
PERSON_VALUES = (
    "_row_id",
    "v",
    "substr('张李王赵刘陈杨黄周吴', cast(k % 10 + 1 as int), 1) || substr('伟芳娜敏静丽强磊洋勇艳杰', cast(k % 12 + 1 as int), 1) AS nm",
    "'13' || cast(p % 7 + 3 as string) || lpad(cast(p % 100000000 as string), 8, '0') AS ph",
    "'user' || cast(k as string) || '@example.com' AS em",
    "cast(k % 5 + 2020 as string) AS yy",
    "cast(k % 12 + 1 as string) AS mm",
    "cast(k % 28 + 1 as string) AS dd",
)
PERSON_CELLS = (
    "_row_id",
    "CASE v WHEN 0 THEN NULL WHEN 1 THEN ph WHEN 9 THEN '  ' || nm || '　' WHEN 11 THEN 'abc' WHEN 15 THEN 'NaN' ELSE nm END AS name",
    "CASE v WHEN 0 THEN '' WHEN 1 THEN em WHEN 2 THEN substr(ph, 1, 3) || '-' || substr(ph, 4, 4) || ' ' || substr(ph, 8, 4) "
    "WHEN 3 THEN '12345' WHEN 11 THEN nm WHEN 12 THEN NULL WHEN 16 THEN ' ' ELSE ph END AS phone",
    "CASE v WHEN 0 THEN ' ' WHEN 1 THEN nm WHEN 4 THEN upper(em) || ' ' WHEN 5 THEN 'not-email' WHEN 10 THEN ph "
    "WHEN 11 THEN ph WHEN 16 THEN ph ELSE em END AS email",
    "CASE v WHEN 0 THEN 'NaT' WHEN 6 THEN yy || '/' || mm || '/' || dd WHEN 7 THEN yy || lpad(mm, 2, '0') || lpad(dd, 2, '0') "
    "WHEN 8 THEN '昨天' WHEN 13 THEN yy || '年' || mm || '月' || dd || '日' WHEN 14 THEN mm || '/' || dd || '/' || yy "
    "WHEN 15 THEN yy || '-' || mm || '-31' WHEN 16 THEN yy || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') || ' 10:30:05' "
    "ELSE yy || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') END AS last_order",
    "CASE v WHEN 0 THEN 'none' ELSE 'city' || cast(v % 4 as string) END AS city",
)

# orders -> amounts, labels and dates as people type them
ORDER_CENTS = ("*", "cast(round(o_totalprice * 100) as bigint) AS cents", "cast(o_orderdate as date) AS day")
ORDER_CELLS = (
    "o_orderkey",
    "CASE o_orderkey % 7 WHEN 0 THEN '￥' || cast(cents as string) || '.50' WHEN 1 THEN cast(cents as string) || '元' "
    "WHEN 2 THEN '1,' || lpad(cast(cents % 1000 as string), 3, '0') WHEN 3 THEN 'n/a' WHEN 4 THEN '1d' "
    "WHEN 5 THEN '　' || cast(cents as string) || ' ' ELSE cast(NULL as string) END AS amount",
    "CASE o_orderkey % 6 WHEN 0 THEN cast(cents as string) || '.0' WHEN 1 THEN cast(cents % 97 + 1 as string) || '.5E+3' "
    "WHEN 2 THEN ' ' || cast(o_custkey as string) || ' ' WHEN 3 THEN 'NaN' WHEN 4 THEN '-' || cast(o_custkey as string) || '.0' "
    "ELSE o_orderpriority END AS code",
    "CASE o_orderkey % 5 WHEN 0 THEN cast(day as string) || ' 0:00:00' WHEN 1 THEN replace(cast(day as string), '-', '/') "
    "WHEN 2 THEN cast(day as string) || ' 08:05:09' WHEN 3 THEN '' ELSE cast(day as string) || 'x' END AS shown",
    "CASE o_orderkey % 4 WHEN 0 THEN replace(o_orderpriority, '-', '/') WHEN 1 THEN '  ' || o_orderpriority || ' . ' "
    "WHEN 2 THEN replace(o_orderpriority, '-', ' \" ') ELSE ' nan ' END AS part",
)

# orders as table B of a comparison: keys that moved, cells that changed
ORDERS_LATER = (
    "o_orderkey AS _row_id",
    "CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 WHEN o_orderkey % 101 = 0 THEN -o_orderkey ELSE o_custkey END AS customer",
    "CASE WHEN o_orderkey % 13 = 0 THEN 'Z' ELSE o_orderstatus END AS status",
    "CASE WHEN o_orderkey % 17 = 0 THEN lower(o_orderpriority) || ' ' ELSE o_orderpriority || ' ' END AS priority",
)
ORDERS_NOW = ("o_orderkey AS _row_id", "o_custkey AS customer", "o_orderstatus AS status", "o_orderpriority AS priority")


def nested_sql(table: str, *layers: tuple[str, ...]) -> str:
    query = f"SELECT {', '.join(layers[0])} FROM {table}"
    for layer in layers[1:]:
        query = f"SELECT {', '.join(layer)} FROM ({query}) s"
    return query


PERSONS_SQL = nested_sql("customer", PERSON_KEYS, PERSON_VALUES, PERSON_CELLS)
ORDER_TEXT_SQL = nested_sql("orders", ORDER_CENTS, ORDER_CELLS)
ORDERS_NOW_SQL = nested_sql("orders", ORDERS_NOW)
ORDERS_LATER_SQL = nested_sql("orders", ORDERS_LATER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _layered(df: DataFrame, *layers: tuple[str, ...]) -> DataFrame:
    for layer in layers:
        if layer[0] == "*" or len(layers) == 1:
            df = df.selectExpr(*layer)
        else:
            df = df.select(F.inline(F.array(F.struct(*[F.expr(e) for e in layer]))))
    return df


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a customer is a few bytes here and much text behind
    keys = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return _layered(keys, PERSON_KEYS, PERSON_VALUES, PERSON_CELLS)


def order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layered(table(spark, sf_dir, "orders"), ORDER_CENTS, ORDER_CELLS)


def orders_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layered(table(spark, sf_dir, "orders"), ORDERS_NOW)


def orders_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layered(table(spark, sf_dir, "orders"), ORDERS_LATER)

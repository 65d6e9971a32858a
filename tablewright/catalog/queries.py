"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.catalog.dirty import order_text, orders_later, orders_now, persons, table
from tablewright.functions import dates as D
from tablewright.functions import text as X
from tablewright.operators import compare as cmp
from tablewright.operators import merge as mrg
from tablewright.operators import sales as sls
from tablewright.operators import split as spl
from tablewright.operators.dedupe import mark_blank_rows, mark_duplicates, split_kept_removed
from tablewright.operators.identity import global_position, occurrence_ordinal, with_row_id
from tablewright.operators.quality import health_score, quality_profile
from tablewright.operators.repair import (
    RepairSteps,
    plan_shift,
    repair_contacts,
    review_reasons,
    role_slots,
    row_markers,
)
from tablewright.operators.schema import ContactRoles, SalesRoles, key_evidence, role_profile, sink_cells
from tablewright.operators.staging import staging_root
from tablewright.plans.jobs import (
    CleanOptions,
    clean_summary,
    clean_table,
    compare_job,
    fix_log,
    mark_cleaned,
    merge_job,
    sales_report,
    split_job,
    with_result_row,
)
from tablewright.sources.files import discover_tables, scan_many, scan_table
from tablewright.sources.sinks import split_files as read_split_files
from tablewright.sources.sinks import write_report, write_result, write_split

Query = Callable[[SparkSession, str], DataFrame]
ROLES = ContactRoles(name="name", phone="phone", email="email", date="last_order")
ALL_STEPS = RepairSteps(True, True, True, True, True, True)
CLEAN = CleanOptions(
    drop_duplicates=True,
    drop_blank_rows=True,
    dedupe_columns=("name", "phone"),
    check_shifted_rows=True,
    fix_phone=True,
    fix_email=True,
    fix_dates=True,
    check_required_fields=True,
)
CLEAN_LATEST = CleanOptions(
    drop_blank_rows=True,
    dedupe_columns=("phone",),
    dedupe_keep="latest",
    dedupe_latest_column="last_order",
    fix_dates=True,
)
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/tablewright/{name}-{uuid4().hex}"


# ---- sales ----------------------------------------------------------------


def _line_amounts(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """Order lines summed per key before any join, so a hot key meets the join as one row."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = table(spark, sf, "lineitem").select(key, cents.alias("cents"), F.col("l_quantity").cast("bigint").alias("units"))
    return lines.groupBy(key).agg(F.sum("cents").alias("cents"), F.sum("units").alias("units"))


def customer_sales(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    per_order = _line_amounts(spark, sf, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    per_customer = per_order.groupBy("o_custkey").agg(F.sum("cents").alias("cents"), F.sum("units").alias("units"))
    names = table(spark, sf, "customer").select("c_custkey", "c_name")
    return per_customer.join(names, F.col("o_custkey") == F.col("c_custkey"))


@query
def sales_by_person(spark, sf):
    roles = SalesRoles(person="c_name", amount="cents", qty="units")
    return sls.sales_by_person(sls.sales_rows(customer_sales(spark, sf), roles))


@query
def sales_by_product(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    lines = _line_amounts(spark, sf, "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    roles = SalesRoles(person="p_brand", amount="cents", qty="units", product="p_name")
    return sls.sales_by_product(sls.sales_rows(lines, roles))


@query
def sales_by_month(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_shipdate", cents.alias("cents"), F.col("l_quantity").cast("bigint").alias("units"))
    roles = SalesRoles(person="l_returnflag", amount="cents", qty="units", date="l_shipdate")
    return sls.sales_by_month(sls.sales_rows(lines, roles))


@query
def sales_by_month_text(spark, sf):
    """Months of typed-in dates; rows whose date does not parse are left out."""
    people = persons(spark, sf)
    rows = people.select("city", "last_order", F.col("_row_id").alias("points"))
    return sls.sales_by_month(sls.sales_rows(rows, SalesRoles(person="city", amount="points", date="last_order")))


@query
def qty_default(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.select("o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return sls.sales_by_person(sls.sales_rows(rows, SalesRoles(person="o_orderpriority", amount="cents")))


@query
def sales_report_job(spark, sf):
    """The whole job on found roles: 姓名, 销售额, 数量, 日期."""
    orders = table(spark, sf, "orders")
    rows = orders.select(
        F.col("o_orderpriority").alias("姓名"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("销售额"),
        F.lit(2).cast("bigint").alias("数量"),
        F.col("o_orderstatus").alias("产品"),
        F.col("o_orderdate").alias("日期"),
    )
    job = sales_report(rows)
    parts = [
        job.result.select(F.lit("person").alias("part"), F.col("person").alias("key"), "amount", "qty"),
        job.report["product"].select(F.lit("product").alias("part"), F.col("product").alias("key"), "amount", "qty"),
        job.report["month"].select(F.lit("month").alias("part"), F.col("month").alias("key"), "amount", "qty"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def coerced_amounts(spark, sf):
    return sls.coerced_amounts(order_text(spark, sf), "amount")


# ---- cells ----------------------------------------------------------------


@query
def to_number(spark, sf):
    return order_text(spark, sf).select("o_orderkey", X.to_number(F.col("amount")).alias("amount"))


@query
def text_cell(spark, sf):
    return order_text(spark, sf).select("o_orderkey", X.text_cell(F.col("code")).alias("code"))


@query
def date_cell(spark, sf):
    return order_text(spark, sf).select("o_orderkey", D.date_cell(F.col("shown")).alias("shown"))


@query
def sink_cells_typed(spark, sf):
    """Typed columns as a result file shows them."""
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("phone"), "ts")
    return sink_cells(events)


@query
def safe_label(spark, sf):
    return order_text(spark, sf).select("o_orderkey", X.safe_label(F.col("part")).alias("label"))


@query
def key_text(spark, sf):
    cells = order_text(spark, sf)
    return cells.select("o_orderkey", X.key_text([F.col("part"), F.col("code")]).alias("key"))


@query
def dedupe_key(spark, sf):
    people = persons(spark, sf)
    key = X.dedupe_key([F.col("name"), F.col("phone")])
    return people.select("_row_id", F.array_join(key, "||").alias("key"))


@query
def blank_modes(spark, sf):
    people = persons(spark, sf)
    modes = ("clean", "split", "merge", "compare")
    return people.select(
        "_row_id", *[X.is_blank(F.col(c), m).alias(f"{c}_{m}") for c in ("name", "phone", "last_order", "city") for m in modes]
    )


@query
def classify_contact(spark, sf):
    people = persons(spark, sf)
    return people.select("_row_id", *[X.classify_contact(F.col(c)).alias(c) for c in ("name", "phone", "email")])


def _fixed(spark, sf, column, fix):
    people = persons(spark, sf).select("_row_id", fix(F.col(column)).alias("f"))
    return people.select("_row_id", "f.value", "f.fixed", "f.problem")


@query
def fix_phone(spark, sf):
    return _fixed(spark, sf, "phone", X.fix_phone)


@query
def fix_email(spark, sf):
    return _fixed(spark, sf, "email", X.fix_email)


@query
def fix_date(spark, sf):
    return _fixed(spark, sf, "last_order", lambda c: D.fix_date(c, D.parse_date(c)))


@query
def month_key(spark, sf):
    return persons(spark, sf).select("_row_id", D.month_key(F.col("last_order")).alias("month"))


@query
def latest_key(spark, sf):
    return persons(spark, sf).select("_row_id", D.latest_key(F.col("last_order")).alias("recency"))


# ---- repairs --------------------------------------------------------------


@query
def fix_shifted(spark, sf):
    people = persons(spark, sf)
    slots = role_slots(people, ROLES)
    held = people.select("_row_id", F.struct(*[c.alias(k) for k, c in slots.items()]).alias("_was"))
    planned = plan_shift(held, list(slots))
    return planned.select("_row_id", "_shift.problem", "_shift.fixed", "_shift.name", "_shift.phone", "_shift.email")


def _repaired(spark, sf):
    return repair_contacts(persons(spark, sf), ROLES, ALL_STEPS)


@query
def repair_rows(spark, sf):
    return _repaired(spark, sf).select("_row_id", "name", "phone", "email", "last_order")


@query
def trim_name(spark, sf):
    repaired = repair_contacts(persons(spark, sf), ROLES, RepairSteps())
    return repaired.select("_row_id", "name", F.size("_fixes").alias("fixes"))


@query
def flag_required(spark, sf):
    repaired = repair_contacts(persons(spark, sf), ROLES, RepairSteps(required=True))
    return repaired.select("_row_id", F.array_join(review_reasons(F.col("_reviews")), ";").alias("reasons"))


@query
def row_marker(spark, sf):
    return _repaired(spark, sf).select("_row_id", row_markers(F.col("_fixes"), F.col("_reviews")).alias("marker"))


@query
def review_rows(spark, sf):
    repaired = _repaired(spark, sf).filter(F.size("_reviews") > 0)
    return repaired.select("_row_id", F.array_join(review_reasons(F.col("_reviews")), ";").alias("reasons"))


@query
def fix_log_rows(spark, sf):
    kept, _ = split_kept_removed(mark_cleaned(persons(spark, sf), CLEAN, ROLES))
    return fix_log(with_result_row(kept, CLEAN)).drop("seq")


# ---- quality --------------------------------------------------------------


@query
def quality_counts(spark, sf):
    return quality_profile(persons(spark, sf), ROLES)


@query
def health(spark, sf):
    return health_score(quality_profile(persons(spark, sf), ROLES)).select("score", "level", "advice")


@query
def column_roles(spark, sf):
    people = persons(spark, sf).toDF("_row_id", "姓名", "手机号", "邮箱", "最近下单", "城市")
    return role_profile(people, distinct=False)


@query
def compare_keys(spark, sf):
    """The columns that orders and their lines share, as keys to compare by."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("状态"), F.col("o_custkey").alias("客户编号"), F.col("o_orderkey").alias("订单号"), F.col("o_orderpriority").alias("级别")
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("订单号"), F.col("l_linestatus").alias("状态"), F.col("l_partkey").alias("客户编号"), F.col("l_quantity").alias("数量")
    )
    return key_evidence(orders, lines)


# ---- duplicates -----------------------------------------------------------


def _events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("_row_id"), "event_id", "user_id", "event_type", F.col("ts").alias("日期")
    )


def _deduped(spark, sf, keep):
    marked = mark_duplicates(_events(spark, sf), key_columns=["user_id", "event_type"], keep=keep, latest_column="日期")
    return split_kept_removed(marked)


@query
def dedupe_first(spark, sf):
    return _deduped(spark, sf, "first")[0].select("event_id", "user_id", "event_type")


@query
def dedupe_last(spark, sf):
    return _deduped(spark, sf, "last")[0].select("event_id", "user_id", "event_type")


@query
def dedupe_latest(spark, sf):
    return _deduped(spark, sf, "latest")[0].select("event_id", "user_id", "event_type")


@query
def dedupe_removed(spark, sf):
    return _deduped(spark, sf, "first")[1].select("_removed_reason", "event_id", "user_id", "event_type")


@query
def full_duplicates(spark, sf):
    events = _events(spark, sf).select("_row_id", "user_id", "event_type", F.to_date("日期").alias("day"))
    return mark_duplicates(events, full=True).select("_row_id", "_removed_reason")


@query
def drop_blank_rows(spark, sf):
    return mark_blank_rows(persons(spark, sf)).select("_row_id", "_removed_reason")


@query
def kept_and_removed(spark, sf):
    marked = mark_duplicates(mark_blank_rows(persons(spark, sf)), full=True, key_columns=["phone"])
    kept, removed = split_kept_removed(marked)
    parts = kept.select(F.lit("kept").alias("part")).unionByName(removed.select(F.col("_removed_reason").alias("part")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def result_row_number(spark, sf):
    kept = _deduped(spark, sf, "first")[0]
    numbered = global_position(kept, "_row_id", "position")
    return numbered.select("event_id", (F.col("position") + 1).alias("result_row"))


@query
def occurrence_number(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return occurrence_ordinal(events, ["event_type"], "event_id", "nth")


# ---- clean job ------------------------------------------------------------


@query
def clean_counts(spark, sf):
    return clean_summary(mark_cleaned(persons(spark, sf), CLEAN, ROLES))


@query
def clean_job(spark, sf):
    return clean_table(persons(spark, sf), CLEAN, ROLES).result.withColumnRenamed("_row_id", "result_row")


@query
def clean_latest_job(spark, sf):
    return clean_table(persons(spark, sf), CLEAN_LATEST, ROLES).result.withColumnRenamed("_row_id", "result_row")


@query
def report_bundle(spark, sf):
    """The six audit tables, written side by side and counted from the files."""
    report = clean_table(persons(spark, sf), CLEAN, ROLES).report
    path = _scratch(spark, "report")
    write_report(report, path)
    counts = [
        spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("report"), "n_rows")
        for name in report
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


# ---- merge ----------------------------------------------------------------


def order_slices(spark, sf):
    """The orders as three tables, one per status, with headers of their own."""
    orders = table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    headers = {
        "F": {"o_orderkey": "订单号", "o_custkey": "客户名", "cents": "金额", "o_orderpriority": "优先级"},
        "O": {"cents": "销售额", "o_orderkey": "订单号", "o_custkey": "联系人", "o_orderpriority": "优先级"},
        "P": {"o_orderkey": "订单号", "cents": "营收", "o_orderpriority": "级别", "o_custkey": "客户　代码"},
    }
    return [
        mrg.named_table(
            orders.filter(F.col("o_orderstatus") == status).select(*[F.col(c).alias(h) for c, h in columns.items()]),
            f"orders_{status}.csv",
            i,
        )
        for i, (status, columns) in enumerate(headers.items())
    ]


@query
def merge_tables(spark, sf):
    return mrg.merge_tables(order_slices(spark, sf))


@query
def null_stats(spark, sf):
    return mrg.null_stats(order_slices(spark, sf)).drop("position", "source_order")


@query
def alignment_warnings(spark, sf):
    return mrg.alignment_warnings(mrg.null_stats(order_slices(spark, sf)))


@query
def alignment_groups(spark, sf):
    return mrg.alignment_groups(mrg.null_stats(order_slices(spark, sf)))


@query
def header_matrix(spark, sf):
    slices = order_slices(spark, sf)
    return mrg.header_matrix(slices, mrg.null_stats(slices)).select("column", "file", "header")


@query
def merge_summary(spark, sf):
    return merge_job(order_slices(spark, sf)).report["summary"]


# ---- split ----------------------------------------------------------------


@query
def split_manifest(spark, sf):
    events = table(spark, sf, "events").withColumn("_row_id", F.col("event_id"))
    return split_job(events, "column", "event_type").report["manifest"]


@query
def split_labels(spark, sf):
    """Parts whose values differ but whose file labels collide."""
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("_row_id"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '/') WHEN 1 THEN replace(p_name, ' ', ':') "
               "WHEN 2 THEN replace(p_name, ' ', '_') ELSE ' none ' END").alias("model"),
    )
    return spl.split_manifest(parts, "model")


def _brands(spark, sf):
    """Parts with a brand whose spellings give the same file name, and some without one."""
    brand = "CASE p_partkey % 4 WHEN 0 THEN replace(p_brand, '#', '/') WHEN 1 THEN replace(p_brand, '#', ':') WHEN 2 THEN replace(p_brand, '#', '_') ELSE ' none ' END"
    return table(spark, sf, "part").select(F.col("p_partkey").alias("_row_id"), F.expr(brand).alias("brand"), "p_name")


@query
def split_files(spark, sf):
    """Parts whose labels collide, written under their file labels: the manifest beside the folders."""
    job = split_job(_brands(spark, sf), "column", "brand")
    path = _scratch(spark, "split")
    write_split(job.result, path, manifest=job.report["manifest"])
    return read_split_files(spark, path, job.report["manifest"]).drop("n_files")


@query
def split_report(spark, sf):
    """Warnings of a split by field, and its totals as one row more."""
    report = split_job(_brands(spark, sf), "column", "brand").report
    return _warnings_and_totals(report)


def _warnings_and_totals(report):
    counts = [F.col(c).cast("string") for c in ("parts", "warnings", "skipped")]
    totals = report["summary"].select(
        F.lit("summary").alias("kind"), F.concat_ws(",", *counts).alias("file_label"), F.lit(None).cast("string").alias("value"), F.col("total_rows").alias("n_rows")
    )
    return report["warnings"].drop("message").unionByName(totals)


@query
def split_rows_report(spark, sf):
    """Warnings and totals of a split by row count, whose last part may be short."""
    return _warnings_and_totals(split_job(scan_table(spark, f"{sf}/orders.parquet"), "rows", rows=700).report)


@query
def split_by_source(spark, sf):
    """Merged tables split again by the table they come from; one that was read had no rows."""
    merged = mrg.merge_tables(order_slices(spark, sf), add_source=False, audit=True)
    rows = merged.drop("_source_order").withColumn("_row_id", F.col("订单号"))
    job = split_job(rows, "sheet", sources=[*(f"orders_{s}.csv" for s in "FOP"), "orders_X.csv"])
    parts = job.report["manifest"].select(F.lit("part").alias("kind"), "file_label", "value", "n_rows")
    return parts.unionByName(_warnings_and_totals(job.report))


@query
def split_blank_key(spark, sf):
    return spl.split_blank_key(persons(spark, sf), "name")[1].select("_row_id", "phone")


@query
def split_written(spark, sf):
    """Rows per part, counted from the files written."""
    path = _scratch(spark, "split")
    write_split(spl.with_bucket(persons(spark, sf), "city"), path)
    files = spark.read.parquet(path)
    return files.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.count("phone").alias("phones"))


@query
def chunk_by_rows(spark, sf):
    lines = scan_table(spark, f"{sf}/lineitem.parquet")
    return split_job(lines, "rows", rows=1000).report["manifest"]


@query
def chunk_rows_ordered(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("_row_id"))
    return spl.chunk_by_rows(orders, 700).select("o_orderkey", F.col("_chunk").alias("chunk"))


# ---- compare --------------------------------------------------------------


def _compared(spark, sf):
    return cmp.compare_tables(orders_now(spark, sf), orders_later(spark, sf), ["customer"])


@query
def compare_status(spark, sf):
    rows = cmp.statuses(orders_now(spark, sf), orders_later(spark, sf), ["customer"])
    return rows.select(F.array_join("_key", "||").alias("key"), F.col("_ord").alias("ord"), F.col("_status").alias("status"))


@query
def compare_changed(spark, sf):
    rows = cmp.changed_rows(_compared(spark, sf), ["customer", "priority", "status"])
    return rows.select(F.array_join("_key", "||").alias("key"), F.col("_ord").alias("ord"), "changed_fields", "status_A", "status_B", "priority_A", "priority_B")


@query
def compare_summary(spark, sf):
    return compare_job(orders_now(spark, sf), orders_later(spark, sf), ["customer"]).report["summary"]


@query
def difference_list(spark, sf):
    rows = cmp.difference_list(_compared(spark, sf), ["customer", "priority", "status"])
    return rows.drop("_key").withColumnsRenamed({"_ord": "ord", "_status": "result"})


@query
def only_in(spark, sf):
    rows = cmp.only_in(orders_later(spark, sf), orders_now(spark, sf), ["customer"])
    return rows.select(F.col("_row_id").alias("o_orderkey"), "customer", "status")


# ---- files ----------------------------------------------------------------


@query
def scan_roundtrip(spark, sf):
    """Written as a CSV result, discovered, and scanned back."""
    path = _scratch(spark, "csv")
    write_result(persons(spark, sf), path, "csv")
    return scan_table(spark, path).select("name", "phone", "email", "last_order", "city")


@query
def scan_many_headers(spark, sf):
    """Two folders of CSV files with different headers, scanned by header and merged."""
    people = persons(spark, sf)
    early, late = _scratch(spark, "csv-a"), _scratch(spark, "csv-b")
    write_result(people.filter("_row_id % 3 = 0").select(F.col("name").alias("联系人"), F.col("phone").alias("电话")), early, "csv")
    write_result(people.filter("_row_id % 3 <> 0").select(F.col("phone").alias("手机"), F.col("name").alias("姓名"), "city"), late, "csv")
    return mrg.merge_tables(scan_many(spark, discover_tables(spark, [early, late])), add_source=False).drop("_row_id")


@query
def scan_odd_cells(spark, sf):
    """Whole texts with line breaks and quotes, and a column with missing cells alone, written as CSV and scanned back.

    A text that came back changed anywhere has a length of -1.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text")
    wide, narrow = _scratch(spark, "csv-wide"), _scratch(spark, "csv-narrow")
    quoted = docs.select(F.concat(F.lit("k"), "doc_id").alias("k"), F.concat(F.lit('"'), "text", F.lit('",')).alias("text"))
    write_result(quoted.select("k", F.concat(F.lit("h"), F.sha2("text", 256)).alias("hash"), "text"), wide, "csv")
    alone = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("d"), F.col("doc_id") % 5))
    write_result(docs.select(alone.alias("cell")), narrow, "csv")
    cells = scan_table(spark, narrow).groupBy("cell").agg(F.count("*").alias("n"))
    same = F.concat(F.lit("h"), F.sha2("text", 256)).eqNullSafe(F.col("hash"))
    length = F.when(F.col("text").isNotNull(), F.length("text"))
    texts = scan_table(spark, wide).select("k", F.when(same, length).otherwise(-1).cast("bigint").alias("n"))
    return texts.unionByName(cells.select(F.concat(F.lit("cell "), F.coalesce("cell", F.lit("-"))).alias("k"), "n"))


def _with_splits_of(spark, size):
    """A session of its own in which files are read in splits of ``size``."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", size)
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    return session


@query
def scan_split_cells(spark, sf):
    """Texts with quotes, commas and line breaks from CSV files that are cut into many splits, in the order written."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = _scratch(spark, "csv-split")
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit('"')).otherwise(F.lit("")), "text", F.lit('\r\n"",'))
    write_result(docs.select("doc_id", text.alias("text"), F.lit(None).cast("string").alias("none")), path, "csv", order_by=["doc_id"])
    read = scan_table(_with_splits_of(spark, "64k"), path)
    placed = global_position(read, "_row_id", "place")
    return placed.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("hash"), "none", "place")


@query
def scan_folder_kv(spark, sf):
    """The files of a folder, not those of a folder in it that is named like a partition."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    folder = _scratch(spark, "folder")
    write_result(parts.where("p_partkey % 3 > 0"), folder, "csv")
    write_result(parts.where("p_partkey % 3 = 0"), f"{folder}/kind=c", "csv")
    return scan_table(spark, folder).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_brand")


@query
def reserved_headers(spark, sf):
    """Columns under names of our bookkeeping, and of columns that steps add on their way, stay columns of the table from scan to result."""
    inner = ("_file", "_place", "_name", "_unique", "_won", "_at", "_offset", "_n", "_key", "_block", "_local")
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"),
        (F.col("event_id") % 7).cast("string").alias("_chunk"),
        (F.col("event_id") % 3).cast("string").alias("_row_id_"),
        *(F.concat(F.lit(c), F.col("event_id") % 2).alias(c) for c in inner),
    )
    first, second = _scratch(spark, "csv"), _scratch(spark, "csv")
    events.withColumnRenamed("_row_id_", "_row_id").write.csv(first, header=True)
    cleaned = clean_table(scan_table(spark, first), CleanOptions(drop_duplicates=True, dedupe_columns=("kind", "_at", "_chunk.1", "_row_id.1", "_offset")))
    write_result(split_job(cleaned.result, "rows", rows=10).result.drop("_chunk"), second, "csv")
    return spark.read.csv(second, header=True)


@query
def merge_ordered(spark, sf):
    """Three tables whose first and last share headers: rows stay in the order of their tables."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    folder = _scratch(spark, "parts")
    for i, status in enumerate("FOP"):
        part = orders.filter(F.col("o_orderstatus") == status).drop("o_orderstatus").orderBy("o_orderkey").coalesce(1)
        part = part.select("o_orderkey", "o_orderpriority") if i != 1 else part.select("o_orderpriority", "o_orderkey")
        part.write.parquet(f"{folder}/{i}")
    groups = scan_many(spark, discover_tables(spark, [f"{folder}/{i}" for i in range(3)]))
    merged = mrg.merge_tables(groups, add_source=False)
    placed = global_position(merged, "_row_id", "place", bits=30)
    return placed.select("o_orderkey", "o_orderpriority", "place")


@query
def merge_widened(spark, sf):
    """Whole numbers of two widths and fractions under one header become numbers; ids that a double would round stay exact."""
    parts = table(spark, sf, "part")
    wide = (F.col("p_partkey") + 2**53).alias("id")
    groups = [
        mrg.named_table(parts.select(F.col("p_size").alias("v"), F.col("p_size").alias("id")), "a", 0),
        mrg.named_table(parts.select(F.col("p_partkey").alias("v"), wide), "b", 1),
        mrg.named_table(parts.select(F.col("p_retailprice").alias("v"), F.col("p_retailprice").alias("id")), "c", 2),
    ]
    merged = mrg.merge_tables(groups)
    return merged.groupBy("来源文件").agg(
        F.round(F.sum("v"), 2).alias("total"),
        F.round(F.max("v"), 2).alias("most"),
        F.sum(F.col("id").cast("decimal(28,2)")).cast("decimal(38,2)").cast("string").alias("ids"),
    )


@query
def occurrence_blocks(spark, sf):
    """Ids spread over many blocks, and a null key that recurs in them."""
    events = table(spark, sf, "events").select(
        (F.col("event_id") * 100_003).alias("_row_id"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind")
    )
    return occurrence_ordinal(events, ["kind"], name="nth")


@query
def positions_blocks(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 70_001).alias("_row_id"))
    return spl.chunk_by_rows(orders, 700).select("o_orderkey", F.col("_chunk").alias("chunk"))


@query
def compare_blocks(spark, sf):
    """The comparison of ``compare_status`` with blocks of 64 ids, which its keys cross."""
    rows = cmp.statuses(orders_now(spark, sf), orders_later(spark, sf), ["customer"], bits=6)
    return rows.select(F.array_join("_key", "||").alias("key"), F.col("_ord").alias("ord"), F.col("_status").alias("status"))


@query
def row_id_ties(spark, sf):
    """Row ids from a column with repeats are ranks, one for each row, so removing duplicates counts right."""
    parts = table(spark, sf, "part").select("p_size", "p_brand")
    marked = mark_duplicates(with_row_id(parts, ["p_size"]), full=True)
    return marked.groupBy("_removed_reason").agg(F.count("*").alias("n"), F.countDistinct("_row_id").alias("ids"))


def _out_of_order(spark, path, order):
    """Rows of a written table that stand before a row they should follow."""
    read = spark.read.parquet(path)
    file, place = F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place")
    rows = read.select(file, place, F.struct(*order).alias("turn")).withColumn("n", F.lit(1))
    written = W.partitionBy("file").orderBy("place")
    inside = rows.withColumn("wrong", F.lag("turn").over(written) > F.col("turn"))
    ends = rows.groupBy("file").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    # a few files of one small report
    across = ends.withColumn("wrong", F.lag("last").over(W.partitionBy(F.lit(1)).orderBy("file")) > F.col("first"))
    return inside.agg(F.count("n").alias("n"), F.count_if("wrong").alias("out_of_order")).crossJoin(
        F.broadcast(across.agg(F.count_if("wrong").alias("files_out_of_order")))
    )


@query
def fix_log_ordered(spark, sf):
    """The repair log of a written report, in order of row and field."""
    path = _scratch(spark, "report")
    write_report({"fixed": clean_table(persons(spark, sf), CLEAN, ROLES).report["fixed"]}, path)
    return _out_of_order(spark, f"{path}/fixed", [F.col("result_row"), F.col("seq")])


@query
def compare_ordered(spark, sf):
    """The written difference list: sections, then whole-key misses, then keys."""
    path = _scratch(spark, "differences")
    write_report({"list": compare_job(orders_now(spark, sf), orders_later(spark, sf), ["customer"]).result}, path)
    return _out_of_order(spark, f"{path}/list", cmp.sink_order())


@query
def split_ordered(spark, sf):
    """Place of every row inside its written part."""
    path = _scratch(spark, "split")
    events = table(spark, sf, "events").select("event_type", "event_id", F.col("event_id").alias("_row_id"))
    write_split(split_job(events, "column", "event_type").result, path)
    read = spark.read.parquet(path)
    inside = F.col("_metadata.row_index").alias("place")
    placed = read.select("event_type", "event_id", F.col("_metadata.file_path").alias("file"), inside)
    wrong = F.lag("event_id").over(W.partitionBy("file").orderBy("place")) > F.col("event_id")
    return placed.withColumn("wrong", wrong).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("wrong").alias("out_of_order"))

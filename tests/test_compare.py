import pytest
from pyspark.sql import functions as F

from tablewright import compare_job
from tablewright.operators.compare import compare_tables, only_in, sink_order, statuses
from tablewright.sources.sinks import _sorted


def counts(job):
    row = job.report["summary"].first()
    return tuple(row[c] for c in ("only_a", "only_b", "changed", "same"))


def test_two_small_tables(table):
    headers = ["手机号", "姓名", "城市"]
    a = table([("13800138001", "张三", "上海"), ("13800138002", "李四", "北京"), ("13800138003", "王五", "广州")], headers)
    b = table([("13800138001", "张三", "杭州"), ("13800138002", "李四", "北京"), ("13800138004", "赵六", "深圳")], headers)
    job = compare_job(a, b, ["手机号"])
    assert counts(job) == (1, 1, 1, 1)
    assert job.result.count() == 3
    changed = job.report["changed"].first()
    assert (changed["changed_fields"], changed["城市_A"], changed["城市_B"]) == ("城市", "上海", "杭州")
    order = [r["_status"] for r in job.result.orderBy(*sink_order()).collect()]
    assert order == ["only_a", "only_b", "changed"]


def test_order_lines(spark):
    line = spark.range(2370).select(
        F.format_string("ORD%05d", F.expr("id div 3")).alias("订单号"), F.format_string("SKU%d", F.expr("id % 3")).alias("商品编码"),
        (F.col("id") % 9).alias("数量"), F.lit("在途").alias("发货状态"), F.col("id").alias("_row_id"),
    )
    i = F.col("_row_id")
    later = line.filter(i >= 120).withColumn("数量", F.when(i < 370, F.col("数量") + 1).otherwise(F.col("数量")))
    added = spark.range(120).select(
        F.format_string("NEW%05d", "id"), F.lit("SKU0"), F.lit(1), F.lit("在途"), F.col("id") + 5000
    )
    job = compare_job(line, later.union(added), ["订单号", "商品编码"])
    assert counts(job) == (120, 120, 250, 2000)


def test_repeated_and_blank_keys_pair_in_order(table):
    columns, types = ["_row_id", "k", "v"], ["long", "string", "string"]
    a = table([(1, "x", "1"), (2, "x", "2"), (3, "x", "3"), (4, None, "n"), (5, "only", "o")], columns, types)
    b = table([(1, "x ", "1"), (2, "x", "9"), (3, "", "n"), (4, "  ", "m")], columns, types)
    rows = {
        (r["_key"][0], r["_ord"]): (r["_status"], r["changed_fields"])
        for r in compare_tables(a, b, ["k"]).collect()
    }
    assert rows == {
        ("x", 1): ("same", ""),
        ("x", 2): ("changed", "v"),
        ("x", 3): ("only_a_surplus", None),
        ("", 1): ("same", ""),
        ("", 2): ("only_b_surplus", None),
        ("only", 1): ("only_a", None),
    }


def test_identical_tables_have_no_differences(table):
    a = table([("1", "a")], ["id", "v"])
    job = compare_job(a, a, ["id"])
    assert job.result.count() == 0
    assert counts(job) == (0, 0, 0, 1)


def test_columns_of_one_side_and_typed_cells(table):
    a = table([("1", 100.0, "x")], ["id", "amount", "extra"], ["string", "double", "string"])
    b = table([("1", 100)], ["id", "amount"], ["string", "long"])
    row = compare_tables(a.withColumn("_row_id", F.lit(1)), b.withColumn("_row_id", F.lit(1)), ["id"]).first()
    assert row["changed_fields"] == "amount、extra"  # "100.0" and "100" differ as text
    same = b.withColumn("_row_id", F.lit(1))
    assert compare_tables(same, same, ["id"]).first()["_status"] == "same"


def test_a_key_with_most_of_the_rows(spark):
    n = 200_000  # spans several id blocks
    a = spark.range(n).select(F.col("id").alias("_row_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    b = a.filter(F.col("_row_id") >= 30).withColumn("v", F.col("v") + F.when(F.col("k") == "hot", 0).otherwise(1))
    got = {r["_status"]: r["count"] for r in compare_tables(a, b, ["k"]).groupBy("_status").count().collect()}
    hot_a = n - (n + 2) // 3
    cold_b = (n + 2) // 3 - 10
    assert got == {"only_a": 10, "only_a_surplus": 20, "changed": cold_b + hot_a - 20}


def test_only_in(table):
    a, b = table([("1", "a"), (None, "b")], ["id", "v"]), table([(" 1", "z")], ["id", "v"])
    assert [r["v"] for r in only_in(a, b, ["id"]).collect()] == ["b"]


def test_missing_keys_are_refused(table):
    a = table([("1",)], ["id"])
    with pytest.raises(ValueError, match="table B"):
        compare_job(a, table([("1",)], ["other"]), ["id"])
    with pytest.raises(ValueError, match="at least one"):
        compare_job(a, a, [])


def test_keys_of_few_rows_meet_in_one_shuffle(spark):
    a = spark.range(3000).select(F.col("id").alias("_row_id"), (F.col("id") % 700).alias("k"), F.lit("x").alias("v"))
    b = a.where("_row_id % 5 > 0").withColumn("v", F.when(F.col("_row_id") % 7 == 0, "y").otherwise("x"))
    few = statuses(a, b, ["k"])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    # blocks of 16 ids: every key is numbered in blocks, keys of one side among them
    lone = spark.range(50).select((F.col("id") + 10_000).alias("_row_id"), F.lit(-1).cast("bigint").alias("k"), F.lit("x").alias("v"))
    for left, right in ((a, b), (a.union(lone), b)):
        whole, cut = (sorted(map(tuple, statuses(left, right, ["k"], bits=bits).collect())) for bits in (16, 4))
        assert whole == cut and len(whole) > 3000 - 1
    mixed = sorted(map(tuple, statuses(a.union(lone), b, ["k"], bits=8).collect()))  # -1 alone in blocks
    assert mixed == whole


def test_sort_keys_are_taken_once(table):
    rows = table([("b", 2), ("a", 10), ("a", 9)], ["k", "_sort0"], ["string", "int"])
    done = _sorted(rows, [F.concat("k", F.lit("!")), F.col("_sort0")])
    assert [tuple(r) for r in done.collect()] == [("a", 9), ("a", 10), ("b", 2)]
    sort = next(line for line in done._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line)
    assert "concat" not in sort

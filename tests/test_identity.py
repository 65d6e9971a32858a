from pyspark.sql import functions as F

from tablewright.operators.identity import global_position, occurrence_ordinal, rank_rows, with_row_id
from tablewright.operators.staging import stage


def test_positions_are_dense_across_blocks_and_spans(spark):
    ids = [7 * i * i + 3 for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "_row_id long").repartition(5)
    got = {r[0]: r[1] for r in global_position(df, bits=4, span_bits=3).collect()}
    assert got == {v: n for n, v in enumerate(sorted(ids))}


def test_ordinals_of_a_hot_key_match_brute_force(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 11}") for i in range(0, 3000, 2)]
    df = spark.createDataFrame(rows, "_row_id long, k string").repartition(7)
    seen, want = {}, {}
    for row_id, key in sorted(rows):
        seen[key] = seen.get(key, 0) + 1
        want[row_id] = seen[key]
    got = {r["_row_id"]: r["_ord"] for r in occurrence_ordinal(df, ["k"], bits=5).collect()}
    assert got == want


def test_no_window_holds_more_rows_than_a_block(spark):
    df = spark.range(2000).select(F.col("id").alias("_row_id"), (F.col("id") % 1).alias("k"))
    plan = occurrence_ordinal(df, ["k"], bits=5)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert all("_block" in line for line in plan.splitlines() if "row_number" in line and "Window" in line)


def test_rank_rows_is_total_and_independent_of_partitions(spark):
    df = spark.range(300).select((F.col("id") % 4).alias("v"), F.format_string("n%03d", "id").alias("name")).repartition(6)
    order = [F.col("v").desc(), F.col("name")]
    want = sorted(((r["v"], r["name"]) for r in df.collect()), key=lambda t: (-t[0], t[1]))
    for partitions in (1, 3, 16):
        ranked = sorted(rank_rows(df, order, "n", partitions=partitions).collect(), key=lambda r: r["n"])
        assert [(r["v"], r["name"]) for r in ranked] == want
        assert [r["n"] for r in ranked] == list(range(1, 301))


def test_row_ids(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, `odd.name` string")
    assert [r["_row_id"] for r in with_row_id(df, ["k"], unique=True).orderBy("k").collect()] == [1, 2]
    named = with_row_id(df, ["odd.name", "k"]).orderBy("k").collect()
    assert [r["_row_id"] for r in named] == [0, 1]
    arrival = with_row_id(df.coalesce(1)).orderBy("_row_id").collect()
    assert [r["k"] for r in arrival] == [2, 1]


def test_stage_keeps_odd_headers(spark):
    df = spark.createDataFrame([(1, "x", None)], "`a b` int, `A B` string, `c;d` string").withColumn("n", F.lit(None))
    back = stage(df)
    assert back.columns == df.columns
    assert [tuple(r) for r in back.collect()] == [(1, "x", None, None)]

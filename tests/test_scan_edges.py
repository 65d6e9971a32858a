"""Inputs that scans and jobs must not lose or mix up."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tablewright import CleanOptions, clean_table, discover_tables, scan_table, write_result
from tablewright.catalog.dirty import orders_later, orders_now
from tablewright.functions.dates import parse_date
from tablewright.operators.compare import compare_tables, statuses
from tablewright.operators.identity import occurrence_ordinal, with_row_id
from tablewright.operators.merge import widened
from pyspark.sql import types as T


def test_line_breaks_and_lone_missing_cells_read_back(spark, table, tmp_path):
    rows = [("a\nb", "x"), ('say "hi", twice', None), ("plain", "y\r\nz")]
    write_result(table(rows, ["k", "v"]), f"{tmp_path}/wide", "csv")
    assert {(r.k, r.v) for r in scan_table(spark, f"{tmp_path}/wide").collect()} == set(rows)
    write_result(table([("a",), (None,), ("b",)], ["k"]), f"{tmp_path}/narrow", "csv")
    assert sorted(str(r.k) for r in scan_table(spark, f"{tmp_path}/narrow").collect()) == ["None", "a", "b"]


def test_surplus_cells_fail_and_missing_cells_do_not(spark, tmp_path):
    (tmp_path / "short.csv").write_text("a,b\n1\n2,3\n")
    assert sorted(str(r.b) for r in scan_table(spark, f"{tmp_path}/short.csv").collect()) == ["3", "None"]
    (tmp_path / "long.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more cells than its header"):
        scan_table(spark, f"{tmp_path}/long.csv").collect()


def test_suffixes_in_any_case(spark, tmp_path):
    for name in ("1.csv", "2.CSV", "3.Csv", "4.txt"):
        (tmp_path / name).write_text("a\n1\n")
    assert [f.rsplit("/", 1)[-1] for f in discover_tables(spark, [str(tmp_path)])] == ["1.csv", "2.CSV", "3.Csv"]


def test_columns_under_reserved_names_stay(spark, table, tmp_path):
    (tmp_path / "in.csv").write_text("姓名,_chunk,_row_id\na,1,x\na,2,x\na,2,x\n")
    job = clean_table(scan_table(spark, f"{tmp_path}/in.csv"), CleanOptions(drop_duplicates=True))
    write_result(job.result, f"{tmp_path}/out", "csv")
    back = spark.read.csv(f"{tmp_path}/out", header=True)
    assert back.columns == ["姓名", "_chunk", "_row_id"] and back.count() == 2
    with pytest.raises(ValueError, match="reserved"):
        clean_table(table([("a", "1")], ["姓名", "_chunk"]), CleanOptions(drop_duplicates=True))


def test_null_keys_are_numbered_across_blocks(spark):
    df = spark.createDataFrame([(0, None), (1, None), (70_000, None), (70_001, None), (2, "k")], "_row_id long, k string")
    got = {r["_row_id"]: r["_ord"] for r in occurrence_ordinal(df, ["k"]).collect()}
    assert got == {0: 1, 1: 2, 70_000: 3, 70_001: 4, 2: 1}


def test_repeated_order_values_get_ids_of_their_own(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert sorted(r["_row_id"] for r in with_row_id(df, ["k"]).collect()) == [0, 1, 2, 3]


def test_numbers_and_dates_widen():
    assert widened({T.IntegerType(), T.LongType()}) == T.LongType()
    assert widened({T.IntegerType(), T.LongType(), T.DoubleType()}) == T.DoubleType()
    assert widened({T.LongType(), T.DecimalType(10, 2)}) == T.DecimalType(21, 2)
    assert widened({T.DateType(), T.TimestampType()}) == T.TimestampType()
    assert widened({T.LongType(), T.StringType()}) == T.StringType()


def test_full_width_digits_are_dates(spark):
    df = spark.createDataFrame([("２０２４-０１-０５",), ("２０２４年１月５日",)], "d string")
    assert {r[0] for r in df.select(parse_date(F.col("d"))).collect()} == {datetime.date(2024, 1, 5)}


def test_comparison_shuffles_at_most_six_times(spark):
    sf = "/root/testdata/sf0.001"
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = statuses(orders_now(spark, sf), orders_later(spark, sf), ["customer"])
        plan, whole = (
            df._jdf.queryExecution().executedPlan().toString()
            for df in (pairs, compare_tables(orders_now(spark, sf), orders_later(spark, sf), ["customer"]))
        )
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hash") <= 6 and plan.count("FileScan") <= 4
    # narrow rows come first; cells only move to be fetched, once from each table, and nothing is sorted to be aggregated
    assert "SortAggregate" not in whole
    assert len(re.findall(r"Exchange hashpartitioning\(_held", whole)) <= 2


def test_registered_query_writes_and_scans_whole_texts(spark, tmp_path, monkeypatch):
    from tablewright.catalog import queries

    tail = 'x' * 450 + '"\n,"" \r\n\\' + "y" * 50
    spark.createDataFrame([(1, tail), (2, "short"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    written, write = [], queries.write_result

    def kept(df, *args):
        if "text" in df.columns:
            written.extend(r["text"] for r in df.collect())
        write(df, *args)

    monkeypatch.setattr(queries, "write_result", kept)
    got = {r.k: r.n for r in queries.scan_odd_cells(spark, str(tmp_path)).collect()}
    assert f'"{tail}",' in written
    assert (got["k1"], got["k2"], got["k3"]) == (len(tail) + 3, 8, None)

    # a change behind the counted part shows
    monkeypatch.setattr(queries, "write_result", lambda df, *args: write(df.withColumns({"text": queries.F.replace("text", queries.F.lit("y"), queries.F.lit("z"))}) if "text" in df.columns else df, *args))
    assert {r.k: r.n for r in queries.scan_odd_cells(spark, str(tmp_path)).collect()}["k1"] == -1

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewright import discover_tables, merge_job, scan_many, scan_table, write_result
from tablewright.operators.merge import merge_tables, named_table


def groups(*tables):
    return [named_table(df, name, i) for i, (name, df) in enumerate(tables)]


def test_aliases_and_source(table):
    a = table([("张三", "13800138001", "100")], ["姓名", "手机", "销售额"])
    b = table([("李四", "13900139001", "200")], ["客户名", "联系电话", "销售金额"])
    job = merge_job(groups(("a.xlsx", a), ("b.xlsx", b)))
    assert job.result.columns == ["来源文件", "姓名", "手机号", "销售额"]
    assert sorted(r["来源文件"] for r in job.result.collect()) == ["a.xlsx", "b.xlsx"]
    summary = job.report["summary"].first()
    assert (summary["files"], summary["rows"], summary["columns"], summary["warnings"]) == (2, 2, 4, 0)
    headers = {(r["column"], r["file"]): r["header"] for r in job.report["headers"].collect()}
    assert headers[("手机号", "a.xlsx")] == "手机→手机号" and headers[("姓名", "a.xlsx")] == "姓名"


def test_different_orders_and_a_missing_column(spark):
    i = F.col("id")
    a = spark.range(400).select(F.format_string("人%d", i).alias("姓名"), F.format_string("138%08d", i).alias("手机号"), i.alias("销售额"))
    b = spark.range(350).select(i.alias("销售额"), F.format_string("人%d", i).alias("姓名"), F.format_string("139%08d", i).alias("手机号"))
    c = spark.range(300).select(F.format_string("人%d", i).alias("姓名"), i.alias("销售额"))
    job = merge_job(groups(("a", a), ("b", b), ("c", c)))
    assert job.result.columns == ["来源文件", "姓名", "手机号", "销售额"]
    assert job.result.count() == 1050 and job.result.filter("`手机号` is null").count() == 300
    stats = {(r["file"], r["column"]): (r["rows"], r["filled"], r["empty"], r["note"]) for r in job.report["null_stats"].collect()}
    assert stats[("c", "手机号")] == (300, 0, 300, "absent")
    assert stats[("a", "手机号")] == (400, 400, 0, "normal")
    warnings = [r["message"] for r in job.report["warnings"].collect()]
    assert warnings == ["列「手机号」在这些来源里没有内容：c"]


def test_columns_that_look_like_one_field(table):
    a = table([("1", "x"), ("2", " ")], ["id", "客户级别"])
    b = table([("3", "y"), ("4", "none")], ["id", "等级"])
    rows = merge_job(groups(("a", a), ("b", b))).report["warnings"].collect()
    twins = [(r["column"], r["other_column"]) for r in rows if r["kind"] == "same_field"]
    assert twins == [("客户级别", "等级")]
    assert len(rows) == 3


def test_an_existing_source_column_is_kept(table):
    a = table([("old", "1")], ["来源文件", "id"])
    merged = merge_tables(groups(("a", a)))
    assert merged.columns == ["来源文件", "来源文件_原表", "id"]
    assert merge_tables(groups(("a", a)), add_source=False).columns == ["来源文件", "id"]


def test_nothing_to_merge():
    with pytest.raises(ValueError):
        merge_tables([])


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_files_are_found_in_order(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("b.csv", "A.csv", "skip.txt"):
        write(folder / name, "x\n1\n")
    single = write(tmp_path / "z.csv", "x\n1\n")
    found = discover_tables(spark, [single, str(folder), str(tmp_path / "missing"), single])
    assert [f.rsplit("/", 1)[-1] for f in found] == ["z.csv", "A.csv", "b.csv"]
    with pytest.raises(ValueError, match="no table found"):
        discover_tables(spark, [str(tmp_path / "missing")])


def test_many_files_one_scan_per_header(spark, tmp_path):
    files = [
        write(tmp_path / "1.csv", '姓名,手机\n张三,1.38E+10\n"李,四",NA\n'),
        write(tmp_path / "2.csv", "﻿姓名,手机\n王五,13900139001.0\n"),
        write(tmp_path / "3.csv", "客户名,城市\n赵六,　上海\n"),
        write(tmp_path / "4.csv", "客户名,城市\n"),
    ]
    found = scan_many(spark, discover_tables(spark, files))
    assert len(found) == 2
    merged = merge_tables(found, audit=True)
    rows = sorted(tuple(r) for r in merged.select("来源文件", "姓名", F.coalesce("手机号", F.lit("-")), F.coalesce("城市", F.lit("-"))).collect())
    assert rows == [
        ("1.csv", "张三", "13800000000", "-"),
        ("1.csv", "李,四", "-", "-"),
        ("2.csv", "王五", "13900139001", "-"),
        ("3.csv", "赵六", "-", "　上海"),
    ]
    assert merge_job(found).report["summary"].first()["files"] == 3  # the empty file is left out


def test_row_ids_follow_file_order(spark, tmp_path):
    for f in range(3):
        write(tmp_path / f"part{f}.csv", "n\n" + "".join(f"{f * 1000 + i}\n" for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = scan_table(spark, str(tmp_path)).orderBy("_row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r["n"]) for r in rows] == list(range(3000))
    assert len({r["_row_id"] for r in rows}) == 3000


def test_empty_and_headless_tables_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        scan_table(spark, write(tmp_path / "e.csv", "a,b\n"))
    with pytest.raises(ValueError, match="header"):
        scan_table(spark, write(tmp_path / "h.csv", '""\n1\n'))


def test_results_keep_identifiers_and_days_as_text(spark, table, tmp_path):
    df = table([("张三", 13800138001.0, "2021-12-03 0:00:00")], ["姓名", "手机号", "入职日期"], ["string", "double", "string"])
    write_result(df, str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row["手机号"], row["入职日期"]) == ("13800138001", "2021-12-03")


def test_numbers_that_a_double_would_round_stay_exact(table):
    def merged(value, dtype):
        ids = table([(value,), (None,)], ["n"], [dtype])
        rows = merge_tables([named_table(ids, "a", 0), named_table(table([(1.5,)], ["n"], ["double"]), "b", 1)])
        return rows.schema["n"].dataType.simpleString(), {r["n"] for r in rows.collect()}

    assert merged(2**53, "bigint") == ("double", {float(2**53), None, 1.5})
    assert merged(2**53 + 1, "bigint") == ("string", {"9007199254740993", None, "1.5"})
    assert merged(2**63 - 1, "bigint") == ("string", {"9223372036854775807", None, "1.5"})
    assert merged(-(2**63), "bigint") == ("double", {-(2.0**63), None, 1.5})
    assert merged(Decimal("0.1"), "decimal(20,2)") == ("double", {0.1, None, 1.5})
    assert merged(Decimal("12345678901234567.25"), "decimal(20,2)") == ("string", {"12345678901234567.25", None, "1.5"})
    assert merged(7, "int") == ("double", {7.0, None, 1.5})


def test_groups_of_columns_filled_alike_and_their_twins(table):
    a = table([("1", "x", "p"), ("2", " ", "q")], ["id", "客户级别", "城市名"])
    b = table([("3", "y"), ("4", "none")], ["id", "等级"])
    c = table([("5", "x", "p")], ["id", "客户级别", "城市名"])
    job = merge_job(groups(("a", a), ("b", b), ("c", c)))
    rows = {r["column"]: (r["group"], r["twin_group"], r["filled_sources"], r["missing_sources"]) for r in job.report["groups"].collect()}
    assert rows == {"客户级别": ("客户级别", "等级", 2, 1), "城市名": ("客户级别", "等级", 2, 1), "等级": ("等级", "客户级别", 1, 2)}
    pairs = {(r["column"], r["other_column"]) for r in job.report["warnings"].collect() if r["kind"] == "same_field"}
    assert pairs == {("客户级别", "等级"), ("城市名", "等级")}


def test_one_source_or_none_filled_gives_no_groups(table):
    a = table([("1", " ")], ["id", "级别"])
    assert merge_job(groups(("a", a))).report["groups"].collect() == []

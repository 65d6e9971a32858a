import pytest
from pyspark.sql import functions as F

from tablewright import SalesRoles, output_layout, sales_report, split_files, split_job, with_wording, write_split


def test_split_by_field(spark, tmp_path):
    df = spark.range(2200).select(F.col("id").alias("_row_id"), F.format_string("部门%02d", F.col("id") % 12).alias("部门"), F.lit("x").alias("v"))
    job = split_job(df, "column", "部门")
    manifest = job.report["manifest"].orderBy("seq").collect()
    assert len(manifest) == 12 and sum(r["n_rows"] for r in manifest) == 2200
    assert [r["value"] for r in manifest] == [f"部门{i:02d}" for i in range(12)]
    write_split(job.result, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 2200 and written.select("part").distinct().count() == 12
    assert set(written.columns) == {"部门", "v", "part"}


def test_labels_that_collide_and_blank_values(table):
    df = table([(1, "a/b"), (2, "a:b"), (3, "a/b"), (4, None), (5, " nan"), (6, "空值")], ["_row_id", "g"], ["long", "string"])
    job = split_job(df, "column", "g")
    rows = [(r["file_label"], r["value"], r["n_rows"], r["note"]) for r in job.report["manifest"].orderBy("seq").collect()]
    assert rows == [
        ("空值", None, 2, "blank_key"),
        ("a_b", "a/b", 2, ""),
        ("a_b_2", "a:b", 1, "renamed"),
        ("空值_2", "空值", 1, "renamed"),
    ]
    assert sorted(r["_row_id"] for r in job.report["review"].collect()) == [4, 5]
    notes = {r["file_label"]: r["note"] for r in with_wording(job.report["manifest"]).collect()}
    assert notes["a_b_2"] == "文件名重复已自动加后缀" and notes["空值"] == "待人工补全拆分字段"


def test_split_by_rows(table):
    df = table([("A", "一"), ("B", "二"), ("C", "三")], ["姓名", "部门"])
    job = split_job(df, "rows", rows=2)
    assert {r["姓名"]: r["_chunk"] for r in job.result.collect()} == {"A": 1, "B": 1, "C": 2}
    rows = [(r["file_label"], r["n_rows"], r["note"]) for r in job.report["manifest"].orderBy("chunk").collect()]
    assert rows == [("第1批_2行", 2, ""), ("第2批_2行", 1, "short")]


def test_split_report_counts_parts_and_warnings(table):
    df = table([(1, "a/b"), (2, "a:b"), (3, "a/b"), (4, None)], ["_row_id", "g"], ["long", "string"])
    report = split_job(df, "column", "g").report
    assert report["summary"].first().asDict() == {"parts": 3, "total_rows": 4, "warnings": 2, "skipped": 0}
    found = {r["kind"]: r["message"] for r in report["warnings"].collect()}
    assert set(found) == {"blank_key", "renamed"} and "a:b" in found["renamed"] and "a_b_2" in found["renamed"]
    by_rows = split_job(df, "rows", rows=2).report
    assert by_rows["summary"].first()["parts"] == 2 and by_rows["warnings"].count() == 0
    nothing = split_job(df.filter("false"), "rows", rows=2).report
    assert nothing["summary"].first().asDict() == {"parts": 0, "total_rows": 0, "warnings": 0, "skipped": 0}
    assert split_job(df.filter("false"), "column", "g").report["summary"].first()["total_rows"] == 0


def test_sheets_without_rows_are_reported(table):
    df = table([("甲", 1), ("甲", 2), ("乙", 3)], ["_source_file", "v"], ["string", "long"])
    job = split_job(df, "sheet", sources=["甲", "乙", "空表", "空表"])
    assert {r["file_label"]: r["n_rows"] for r in job.report["manifest"].collect()} == {"甲": 2, "乙": 1}
    assert [(r["kind"], r["value"]) for r in job.report["warnings"].collect()] == [("skipped_empty", "空表")]
    assert job.report["summary"].first().asDict() == {"parts": 2, "total_rows": 3, "warnings": 1, "skipped": 1}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_folders_bear_the_labels_of_the_manifest(table, tmp_path, fmt):
    rows = [(1, "a/b", "x\ny"), (2, "a:b", None), (3, "a/b", ""), (4, None, "z"), (5, "01", "q"), (6, "1", '"'), (7, "空值", "w")]
    job = split_job(table(rows, ["_row_id", "g", "_label"], ["long", "string", "string"]), "column", "g")
    path = str(tmp_path / "out")
    write_split(job.result, path, fmt, manifest=job.report["manifest"])
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"part={x}" for x in ("a_b", "a_b_2", "空值", "空值_2", "01", "1")}
    found = split_files(job.result.sparkSession, path, job.report["manifest"], fmt).collect()
    assert len(found) == 6 and all(r["n_rows"] == r["written_rows"] and r["n_files"] == 1 for r in found)
    missing = split_files(job.result.sparkSession, path, job.report["manifest"].filter("value = '1'"), fmt)
    assert missing.filter("n_rows IS NULL").count() == 5


def test_split_arguments(table):
    df = table([("A",)], ["姓名"])
    with pytest.raises(ValueError, match="split column"):
        split_job(df, "column", "无")
    with pytest.raises(ValueError, match="mode"):
        split_job(df, "pages")
    with pytest.raises(ValueError, match="at least 1"):
        split_job(df, "rows", rows=0)


def test_a_hot_part_is_cut_into_several_write_tasks(spark):
    df = spark.range(1000).select(F.lit("hot").alias("_bucket"), "id")
    plan = df.hint("rebalance", "_bucket")._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan


def test_sales_report(spark):
    i = F.col("id")
    df = spark.range(5200).select(
        F.expr("make_date(2025, cast(id % 12 + 1 as int), cast(id % 28 + 1 as int))").alias("日期"),
        F.format_string("销售%02d", i % 20 + 1).alias("销售人员"),
        F.format_string("产品%02d", i % 30 + 1).alias("产品"),
        (i % 12 + 1).alias("数量"),
        (i * 7 % 8000).alias("销售额"),
    )
    job = sales_report(df)
    people = job.result.orderBy("rank").collect()
    assert [r["rank"] for r in people] == list(range(1, 21))
    amounts = [r["amount"] for r in people]
    assert amounts == sorted(amounts, reverse=True)
    assert job.report["product"].count() == 30
    months = job.report["month"].collect()
    assert [r["month"] for r in months] == [f"2025-{m:02d}" for m in range(1, 13)]
    assert sum(amounts) == sum(r["amount"] for r in months) == sum(k * 7 % 8000 for k in range(5200))


def test_sales_of_typed_in_amounts(table):
    df = table([("a", "￥1,000元", "2024/1/5"), ("a", "x", "bad"), (None, "5", None)], ["姓名", "金额", "日期"])
    job = sales_report(df, SalesRoles(person="姓名", amount="金额", date="日期"))
    assert {r["person"]: (r["amount"], r["qty"]) for r in job.result.collect()} == {"a": (1000.0, 2), None: (5.0, 1)}
    assert [(r["month"], r["qty"]) for r in job.report["month"].collect()] == [("2024-01", 1)]
    assert job.report["product"].count() == 0
    assert job.report["coerced"].first()["coerced_to_zero"] == 1
    with pytest.raises(ValueError, match="amount"):
        sales_report(df, SalesRoles(person="姓名"))


def test_output_layout():
    paths = output_layout("/out/", "clean", ' a/b: "c". ', "20240101_0900")
    assert paths == {
        "result": "/out/clean/a_b_ _c_/result_20240101_0900",
        "report": "/out/clean/a_b_ _c_/report_20240101_0900",
    }
    assert output_layout("/out", "merge", "", "s", "named")["result"] == "/out/named"

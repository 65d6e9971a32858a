import pytest
from pyspark.sql import functions as F

from tablewright import CleanOptions, ContactRoles, clean_table, with_wording
from tablewright.functions.names import named
from tablewright.operators.dedupe import mark_duplicates, split_kept_removed
from tablewright.operators.quality import health_score, quality_profile
from tablewright.operators.repair import RepairSteps, repair_contacts
from tablewright.plans.jobs import mark_cleaned, removal_text

HEADERS = ["姓名", "手机号", "邮箱", "最近下单"]
UNTIDY = [
    ("张三", "13800138001", "a@test.com", "2024-01-02"),
    ("13900139001", "b@test.com", "李四", "2024/3/5"),
    ("王五", "138-0013-8002", "C@TEST.COM", "20240308"),
    ("赵六", "12345", "not-email", "昨天"),
    ("abc", "王七", "13800138888", "2024-01-01"),
]
REPAIR = CleanOptions(check_shifted_rows=True, fix_phone=True, fix_email=True, fix_dates=True)


def test_repairs_and_flags(table):
    job = clean_table(table(UNTIDY, HEADERS), REPAIR)
    rows = [tuple(r) for r in job.result.orderBy("_row_id").drop("_row_id").collect()]
    assert rows == [
        ("张三", "13800138001", "a@test.com", "2024-01-02"),
        ("李四", "13900139001", "b@test.com", "2024-03-05"),
        ("王五", "13800138002", "c@test.com", "2024-03-08"),
        ("赵六", "12345", "not-email", "昨天"),
        ("abc", "王七", "13800138888", "2024-01-01"),
    ]
    fixed = job.report["fixed"].orderBy("result_row", "seq").collect()
    assert [(r["result_row"], r["field"], r["reason"]) for r in fixed] == [
        (2, "姓名", "fix_shift"),
        (2, "手机号", "fix_shift"),
        (2, "邮箱", "fix_shift"),
        (2, "最近下单", "fix_date"),
        (3, "手机号", "fix_phone"),
        (3, "邮箱", "fix_email"),
        (3, "最近下单", "fix_date"),
    ]
    review = {r["result_row"]: r["reasons"] for r in job.report["review"].collect()}
    assert review == {4: ["invalid_phone", "invalid_email", "bad_date"], 5: ["shift_unrecognised"]}
    quality = job.report["quality"].first()
    assert (quality["shifted"], quality["bad_phone"], quality["bad_email"], quality["bad_date"]) == (2, 1, 1, 1)
    assert (quality["score"], quality["level"]) == (45, "poor")
    markers = [r["marker"] for r in job.report["review_view"].orderBy("result_row").collect()]
    assert markers == ["", "fixed", "fixed", "to_review", "to_review"]
    summary = job.report["summary"].first()
    assert (summary["original_rows"], summary["cleaned_rows"], summary["fixed_cells"], summary["review_rows"]) == (5, 5, 7, 2)
    assert job.report["removed"].count() == 0


def customers(spark):
    """3,080 rows: 2,600 people, 200 copies, 150 with a taken phone, 80 blank, 50 partly blank."""
    i = F.col("id")
    phone = lambda n: F.concat(F.lit("138"), F.lpad(n.cast("string"), 8, "0"))
    base = lambda n: [
        F.concat(F.lit("人"), n.cast("string")), phone(n), F.format_string("user%d@example.com", n),
        F.format_string("ORD%05d", n), F.format_string("C%04d", n),
    ]
    none = F.lit(None).cast("string")
    parts = [
        spark.range(2600).select("id", *base(i)),
        spark.range(200).select(i + 2600, *base(i)),
        spark.range(150).select(i + 2800, F.concat(F.lit("重复"), i.cast("string")), phone(i), F.format_string("dup%d@example.com", i), F.format_string("DUP%05d", i), none),
        spark.range(80).select(i + 2950, none, none, F.lit(" "), none, F.lit("nan")),
        spark.range(50).select(i + 3030, F.format_string("空%d", i), none, F.lit(""), F.format_string("BLANK%03d", i), none),
    ]
    out = parts[0].toDF("_row_id", "姓名", "手机号", "邮箱", "订单号", "客户编号")
    for part in parts[1:]:
        out = out.union(part)
    return out


@pytest.mark.parametrize("partitions", ["1", "7", "64"])
def test_removed_rows_do_not_depend_on_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        options = CleanOptions(drop_duplicates=True, drop_blank_rows=True, dedupe_columns=("手机号",))
        job = clean_table(customers(spark).repartition(int(partitions)), options)
        summary = job.report["summary"].first()
        assert (summary["blank_deleted"], summary["duplicate_deleted"], summary["field_deleted"]) == (80, 200, 150)
        assert (summary["original_rows"], summary["cleaned_rows"]) == (3080, 2650)
        assert job.report["removed"].count() == 430
        kept = job.result.filter("`手机号` is not null")
        assert kept.count() == kept.select("手机号").distinct().count()
        numbers = sorted(r["_row_id"] for r in job.result.collect())
        assert numbers == list(range(1, 2651))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_keep_latest_with_composite_key(table):
    rows = [
        ("张三", "13800138001", "2024-06-01", "新"),
        ("张三", "13800138001", "2024-01-01", "旧"),
        ("李四", "13900139001", "2024/2/1", "A"),
        ("李四", "13900139002", "2024-03-01", "B"),
    ]
    options = CleanOptions(dedupe_columns=("姓名", "手机号"), dedupe_keep="latest", dedupe_latest_column="更新时间")
    job = clean_table(table(rows, ["姓名", "手机号", "更新时间", "备注"]), options)
    notes = [r["备注"] for r in job.result.orderBy("_row_id").collect()]
    assert notes == ["A", "B", "新"]  # old to new


def test_keep_modes(table):
    df = table([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, " ", "z")], ["_row_id", "k", "v"], ["long", "string", "string"])
    for keep, kept in (("first", [1, 3, 4]), ("last", [2, 3, 4]), ("whatever", [1, 3, 4])):
        rows, removed = split_kept_removed(mark_duplicates(df, key_columns=["k"], keep=keep))
        assert sorted(r["_row_id"] for r in rows.collect()) == kept
        assert removed.columns[0] == "_removed_reason" and removed.count() == 1


def test_null_and_empty_text_are_different_rows_but_nulls_are_equal(table):
    df = table([(1, None), (2, None), (3, "")], ["_row_id", "a"], ["long", "string"])
    marked = {r["_row_id"]: r["_removed_reason"] for r in mark_duplicates(df, full=True).collect()}
    assert marked == {1: None, 2: "full_duplicate", 3: None}


def test_second_run_repairs_nothing(table):
    first = clean_table(table(UNTIDY, HEADERS), REPAIR)
    second = clean_table(first.result, REPAIR)
    assert second.report["summary"].first()["fixed_cells"] == 0


def test_shift_into_a_column_the_table_lacks(table):
    df = table([(1, "a@b.com", "张三")], ["_row_id", "姓名", "手机号"], ["long", "string", "string"])
    roles = ContactRoles(name="姓名", phone="手机号")
    moved = repair_contacts(df, roles, RepairSteps(move_shifted=True)).first()
    assert (moved["姓名"], moved["手机号"]) == ("张三", "")
    assert [f["old"] for f in moved["_fixes"]] == ["a@b.com", "张三"]
    kept = repair_contacts(df, roles, RepairSteps(move_shifted=True, strict_shift=True)).first()
    assert (kept["姓名"], kept["手机号"]) == ("a@b.com", "张三")
    assert {r["reason"] for r in kept["_reviews"]} == {"shift_unrecognised"}


def test_two_values_of_one_kind_are_left_for_review(table):
    df = table([("张三", "13800138001", "13800138002")], HEADERS[:3])
    row = clean_table(df, REPAIR)
    assert row.report["review"].first()["reasons"] == ["shift_ambiguous"]


def test_required_cells_are_flagged(table):
    df = table([(" ", None, "a@b.com")], HEADERS[:3])
    job = clean_table(df, CleanOptions(check_required_fields=True))
    assert job.report["review"].first()["reasons"] == ["missing_name", "missing_phone"]


def test_health_of_an_empty_table(table):
    row = health_score(quality_profile(table([], HEADERS))).first()
    assert (row["total"], row["score"], row["level"]) == (0, 100, "good")


def test_options_are_checked_before_any_job(table):
    df = table(UNTIDY, HEADERS)
    with pytest.raises(ValueError, match="cleaning step"):
        mark_cleaned(df, CleanOptions(trim_spaces=False))
    with pytest.raises(ValueError, match="dedupe column"):
        mark_cleaned(df, CleanOptions(dedupe_columns=("无",)))
    with pytest.raises(ValueError, match="latest"):
        mark_cleaned(df, CleanOptions(dedupe_columns=("姓名",), dedupe_keep="latest"))


def test_report_wording(table):
    options = CleanOptions(dedupe_columns=("姓名", "手机号"), dedupe_keep="last")
    codes = table([("blank_row",), ("key_duplicate",)], ["code"])
    texts = [r[0] for r in codes.select(removal_text(named("code"), options)).collect()]
    assert texts == ["空白行", "按姓名 + 手机号去重（保留最后一条）"]


def test_report_tables_in_words(table):
    report = clean_table(table(UNTIDY, HEADERS), REPAIR).report
    review = {r["result_row"]: r["reasons"] for r in with_wording(report["review"]).collect()}
    assert len(review[4].split("；")) == 3
    markers = [r["marker"] for r in with_wording(report["review_view"]).orderBy("result_row").collect()]
    assert markers == ["", "已修复", "已修复", "待核对", "待核对"]
    assert with_wording(report["quality"]).first()["level"] == "较差"
    reasons = {r["reason"] for r in with_wording(report["fixed"]).collect()}
    assert "错列的值已放回所属列" in reasons


def test_repairs_run_on_a_stream(spark, table, tmp_path):
    df = table(UNTIDY, HEADERS)
    df.write.parquet(str(tmp_path / "in"))
    roles = ContactRoles(name="姓名", phone="手机号", email="邮箱", date="最近下单")
    steps = RepairSteps(True, True, True, True, True, True)
    stream = repair_contacts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), roles, steps)
    query = stream.writeStream.format("memory").queryName("repaired_rows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    streamed = {tuple(r)[:4] for r in spark.table("repaired_rows").collect()}
    assert streamed == {tuple(r)[:4] for r in repair_contacts(df, roles, steps).collect()}


def test_repair_is_dealt_out_by_rows(spark, tmp_path):
    from tablewright.operators.identity import ROW_ID, spread
    from tablewright.plans.jobs import mark_cleaned

    # a few bytes in one file, read by one task
    spark.range(2000).selectExpr("id AS _row_id", "'张三' AS name", "'13800000000' AS phone").coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert one.rdd.getNumPartitions() == 1
    marked = mark_cleaned(one, CleanOptions(fix_phone=True))
    written = marked.groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(written) > 1 and max(r["count"] for r in written) < 1000
    assert sorted(r[ROW_ID] for r in spread(one).collect()) == list(range(2000))

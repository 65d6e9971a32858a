from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import dates as D
from tablewright.functions import text as X
from tablewright.operators import schema as S


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.select(expr(F.col("c")).alias("v"), "i").orderBy("i").select("v").collect()]


def test_parse_date(spark):
    cases = {
        "2024-1-5": date(2024, 1, 5),
        "2024/01/05": date(2024, 1, 5),
        "2024.1.05": date(2024, 1, 5),
        "20240308": date(2024, 3, 8),
        "2024115": date(2024, 11, 5),
        "202411": date(2024, 1, 1),
        "202405": None,
        "2024-01-05 10:30:59": date(2024, 1, 5),
        "2024-01-05 10:30": date(2024, 1, 5),
        "2024-01-05T10:30": None,
        "2024年6月18日": date(2024, 6, 18),
        "2024年6月18": date(2024, 6, 18),
        "2024 6 18": date(2024, 6, 18),
        "03/04/2024": date(2024, 3, 4),
        "13/04/2024": date(2024, 4, 13),
        "15-08-2024": None,
        "2024-02-30": None,
        "2024-13-01": None,
        "02/30/2024": None,
        "　2024-05-06 ": date(2024, 5, 6),
        "0000-01-01": None,
        "昨天": None,
        "": None,
        "nan": None,
        None: None,
    }
    assert column(spark, list(cases), D.parse_date) == list(cases.values())


def test_typed_dates_are_rewritten_without_a_fix(spark):
    fixed = column(spark, [date(2024, 1, 2)], lambda c: D.fix_date(c, D.parse_date(c, T.DateType()), T.DateType()), "date")
    assert fixed[0].asDict() == {"value": "2024-01-02", "fixed": False, "problem": None}


def test_date_cell(spark):
    cases = {
        "2021-12-03 0:00:00": "2021-12-03",
        "2021/2/3": "2021-02-03",
        "2021-12-03 08:05:09": "2021-12-03 08:05:09",
        "2021/1/3 8:5:9": "2021-01-03 08:05:09",
        "2021-12-03 0:00:00.000": "2021-12-03",
        "2021-02-30": "2021-02-30",
        " x ": " x ",
        "  ": None,
        None: None,
    }
    assert column(spark, list(cases), D.date_cell) == list(cases.values())
    stamps = [datetime(2024, 1, 15), datetime(2024, 1, 15, 1, 2, 3)]
    shown = column(spark, stamps, lambda c: D.date_cell(c, T.TimestampType()), "timestamp")
    assert shown == ["2024-01-15", "2024-01-15 01:02:03"]


def test_phone_and_email(spark):
    phones = {
        "138-0013-8002": ("13800138002", True, None),
        "13800138002": ("13800138002", False, None),
        "+86 13800138002": ("+86 13800138002", False, "invalid_phone"),
        "12345": ("12345", False, "invalid_phone"),
        "12800138002": ("12800138002", False, "invalid_phone"),
        " ": (" ", False, None),
        None: (None, False, None),
    }
    assert [tuple(v) for v in column(spark, list(phones), X.fix_phone)] == list(phones.values())
    emails = {
        "C@TEST.COM": ("c@test.com", True, None),
        "a b@test.com": ("ab@test.com", True, None),
        "a@test": ("a@test", False, "invalid_email"),
        "a@test.c1": ("a@test.c1", False, "invalid_email"),
        "NaN": ("NaN", False, None),
    }
    assert [tuple(v) for v in column(spark, list(emails), X.fix_email)] == list(emails.values())


def test_classify_contact(spark):
    cases = {
        "13800138001": "phone",
        "13800138001@qq.com": "phone",
        "a@b.c": "email",
        "张三": "name",
        " 欧阳 娜娜　": "name",
        "张·三": "name",
        "张": "unknown",
        "手机号暂无": "name",
        "abc": "unknown",
        "<NA>": "blank",
        "　": "blank",
        None: "blank",
    }
    assert column(spark, list(cases), X.classify_contact) == list(cases.values())
    assert column(spark, ["张三", "张三13800138001", "abc"], X.looks_like_chinese_name) == [True, False, False]


def test_text_cell(spark):
    cases = {
        "1.38E+10": "13800000000",
        "13800138001.0": "13800138001",
        "-12.0": "-12",
        "12-3.0": "12-3",
        "1.5e-3": "1.5e-3",
        " ab ": "ab",
        "None": None,
        "1e+x": "1e+x",
        None: None,
    }
    assert column(spark, list(cases), X.text_cell) == list(cases.values())
    numbers = {13800138001.0: "13800138001", 0.5: "0.5", 1e-05: "1e-05", 12345678.25: "12345678.25", float("nan"): None}
    assert column(spark, list(numbers), lambda c: X.text_cell(c, T.DoubleType()), "double") == list(numbers.values())
    assert column(spark, [13800138001], lambda c: X.text_cell(c, T.LongType()), "long") == ["13800138001"]


def test_plain_text_of_numbers_reads_like_python(spark):
    values = [100.0, 0.1, 1e-05, 1.5e-12, 12345678.5, 0.00012345678901234567, 1e22, -2.5, 0.0]
    assert column(spark, values, lambda c: X.plain_text(c, T.DoubleType()), "double") == [repr(v) for v in values]
    assert column(spark, [True, False], lambda c: X.plain_text(c, T.BooleanType()), "boolean") == ["True", "False"]


def test_to_number(spark):
    cases = {"￥1,234.5元": 1234.5, "1d": 0.0, "n/a": 0.0, None: 0.0, "1e3": 1000.0, "-7": -7.0, "NaN": 0.0}
    assert column(spark, list(cases), X.to_number) == list(cases.values())
    assert column(spark, [None, 3], lambda c: X.to_number(c, T.LongType()), "long") == [0, 3]


def test_safe_label(spark):
    cases = {'a/b:c*d?e"f<g>h|i\\j': "a_b_c_d_e_f_g_h_i_j", " . a  b . ": "a b", "None": "空值", "...": "空值", "x" * 90: "x" * 80}
    assert column(spark, list(cases), X.safe_label) == list(cases.values())


def test_blank_has_four_meanings(spark):
    values = [None, " ", "nan", "none", "nat", "<na>", "x"]
    wanted = {
        "clean": [True, True, True, True, True, True, False],
        "split": [True, True, True, True, True, False, False],
        "merge": [True, True, True, False, False, False, False],
        "compare": [True, False, False, False, False, False, False],
    }
    for mode, answer in wanted.items():
        assert column(spark, values, lambda c: X.is_blank(c, mode)) == answer


def test_keys_keep_their_parts_apart(spark):
    rows = spark.createDataFrame([("a||b", "c"), ("a", "b||c"), (None, " ")], "x string, y string")
    keys = [r[0] for r in rows.select(X.dedupe_key([F.col("x"), F.col("y")])).collect()]
    assert keys == [["a||b", "c"], ["a", "b||c"], None]


def test_latest_key(spark):
    assert column(spark, [None, "2024/1/5", "昨天"], D.latest_key) == ["0", "12024-01-05", "1昨天"]
    assert column(spark, ["昨天"], lambda c: D.latest_key(c, None, "oldest")) == ["0"]


def test_headers_and_roles():
    assert S.normalize_header("　客户　 名 ") == "客户 名"
    assert S.align_headers(["手机", "Phone", "手机号", "姓名"]) == ["手机号", "手机号_2", "手机号_3", "姓名"]
    assert S.distinct_headers(["a", "a", None, "a"]) == ["a", "a.1", "Unnamed: 2", "a.2"]
    assert S.contact_roles(["联系电话", "客户名", "email", "下单日"]) == S.ContactRoles("客户名", "联系电话", "email", "下单日")
    sales = S.sales_roles(["日期", "销售人员", "产品", "数量", "销售额"])
    assert sales == S.SalesRoles("销售人员", "销售额", "数量", "产品", "日期")
    assert S.sales_roles(["销售额", "店员"]).person is None
    assert S.suggest_dedupe_key(["姓名", "客户手机"]) == "客户手机"
    assert S.suggest_latest_column(["姓名", "更新时间"]) == "更新时间"
    assert S.suggest_compare_key(["姓名", "订单号"], ["订单号", "姓名"]) == "订单号"
    with pytest.raises(ValueError):
        S.suggest_compare_key(["a"], ["b"])
    assert S.order_columns(["b", "k"], ["a", "k"], ["k"]) == ["k", "a", "b"]


def test_key_evidence_prefers_unique_cells_over_headers(spark):
    left = spark.range(500).selectExpr("'x' AS `城市`", "id % 3 AS `编号`", "id AS code", "cast(id AS string) AS note")
    right = spark.range(400).selectExpr("concat(' ', id, ' ') AS code", "id % 3 AS `编号`", "cast(id + 10000 AS string) AS note", "'' AS `城市`")
    rows = {r["column"]: r for r in S.key_evidence(left, right).collect()}
    assert [c for c, r in sorted(rows.items(), key=lambda x: x[1]["rank"])] == ["code", "编号", "城市", "note"]
    assert rows["note"]["unique_left"] and not rows["note"]["overlaps"]
    assert rows["编号"]["hinted"] and rows["编号"]["overlaps"] and not rows["编号"]["unique_right"]
    assert not rows["城市"]["unique_right"]
    empty = S.key_evidence(left.limit(0), right).collect()
    assert len(empty) == 4 and not any(r["overlaps"] or r["unique_left"] for r in empty)
    with pytest.raises(ValueError):
        S.key_evidence(left.select("code"), right.select("note"))


def test_long_identifiers_keep_every_digit_of_their_double(spark):
    texts = ["1E+23", "9.1E+18", "9.3e+18", "-1e+23", "1.8446744073709552e+19", "1.2345678901234567e+30", "3.3e+37", "4.2e+37", "1e+22", "-7.77e+36"]
    texts += [f"{2.0**i!r}" for i in range(63, 125, 3) if "e+" in repr(2.0**i)] + [repr(2.0**i * (1 + 2**-52)) for i in range(64, 125, 5)]
    want = [str(int(float(x))) for x in texts]
    assert column(spark, texts, X.text_cell) == want
    assert column(spark, [float(x) for x in texts], lambda c: X.text_cell(c, T.DoubleType()), "double") == want
    assert column(spark, ["1e+40"], X.text_cell) == ["1e+40"]

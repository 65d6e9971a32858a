import zipfile
from xml.sax.saxutils import escape

from tablewright import merge_job, split_job
from tablewright.operators.merge import merge_tables
from tablewright.sources.workbook import scan_workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def cell(ref, value):
    if isinstance(value, tuple):  # (serial, style)
        return f'<c r="{ref}" s="{value[1]}"><v>{value[0]}</v></c>'
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if value.startswith("="):
        return f'<c r="{ref}" t="s"><v>{value[1:]}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'


def workbook(path, sheets, strings=()):
    with zipfile.ZipFile(path, "w") as book:
        tags = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f"<workbook {NS} {REL}><sheets>{tags}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        items = "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r><rPh><t>x</t></rPh></si>" for s in strings)
        book.writestr("xl/sharedStrings.xml", f"<sst {NS}>{items}</sst>")
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy/m/d h:mm"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        )
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(
                f'<row r="{r}">' + "".join(cell(f"{chr(65 + c)}{r}", v) for c, v in cells.items()) + "</row>"
                for r, cells in rows.items()
            )
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
    return str(path)


def test_sheets_become_tables(spark, tmp_path):
    path = workbook(
        tmp_path / "multi.xlsx",
        {
            "华东": {1: {0: "姓名", 1: "手机号", 2: "日期", 3: "额"}, 2: {0: "=0", 1: 13800138001, 2: (45292, 1), 3: 1.5}},
            "空": {},
            "只有表头": {1: {0: "姓名"}},
            "华南": {
                1: {0: "姓名", 1: "手机号", 2: "日期", 3: "额"},
                2: {0: "李四", 1: "1.39E+10", 2: (45292.5, 2), 3: True},
                4: {0: "NA", 3: 100.0},
                9: {},
            },
        },
        strings=("张三",),
    )
    scan = scan_workbooks(spark, [path])
    assert scan.skipped == ["空", "只有表头"] and len(scan.groups) == 1
    rows = [tuple(r) for r in scan.groups[0].rows.orderBy("_row_id").select("_source_file", "姓名", "手机号", "日期", "额").collect()]
    assert rows == [
        ("华东", "张三", "13800138001", "2024-01-01", "1.5"),
        ("华南", "李四", "13900000000", "2024-01-01 12:00:00", "True"),
        ("华南", None, None, None, None),
        ("华南", None, None, None, "100"),
    ]
    job = split_job(merge_tables(scan.groups, add_source=False, audit=True), "sheet")
    assert {r["value"]: r["n_rows"] for r in job.report["manifest"].collect()} == {"华东": 1, "华南": 3}


def test_many_workbooks_merge_by_header(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"S": {1: {0: "姓名", 1: "手机"}, 2: {0: "张三", 1: 13800138001}}, "T": {1: {0: "x"}, 2: {0: 1}}})
    workbook(tmp_path / "B.xlsx", {"S": {1: {0: "客户名", 1: "联系电话"}, 2: {0: "李四", 1: "13900139001"}}})
    scan = scan_workbooks(spark, [str(tmp_path)], sheets="first")
    job = merge_job(scan.groups)
    rows = sorted(tuple(r) for r in job.result.drop("_row_id").collect())
    assert rows == [("B.xlsx", "李四", "13900139001"), ("a.xlsx", "张三", "13800138001")]
    assert job.result.columns == ["来源文件", "姓名", "手机号", "_row_id"]

"""Ingest folders of multi-sheet ``.xlsx`` workbooks.

Every sheet is read by one task (the format caps a sheet at 1,048,576 rows) and
written to a stage as rows of text cells; tables are then ordinary scans of that
stage, one per distinct header row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tablewright.functions.names import named
from tablewright.operators.identity import FILE_BITS, ROW_ID
from tablewright.operators.merge import ORDER, SOURCE, HeaderGroup
from tablewright.operators.schema import normalize_text_columns
from tablewright.operators.staging import stage
from tablewright.sources.files import clean_headers, discover_tables, null_tokens

SHEETS = "place int, path string, number int, sheet string"
ROWS = "place int, row_no bigint, header_id string, cells array<string>"


@dataclass(frozen=True)
class WorkbookScan:
    groups: list[HeaderGroup]
    skipped: list[str]  # sheets without a header or without rows


def _archive_opener():
    """Closures over library modules only: executors run them without this package."""

    def archive(path: str):
        import zipfile

        from pyarrow import fs

        if "://" in path:
            system, inner = fs.FileSystem.from_uri(path)
        else:
            system, inner = fs.LocalFileSystem(), path.removeprefix("file:")
        return zipfile.ZipFile(system.open_input_file(inner))

    return archive


def _sheet_lister():
    """Task side: sheet names of every workbook."""
    archive = _archive_opener()

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree as ET

        for batch in batches:
            found = []
            for place, path in zip(batch["place"], batch["path"]):
                with archive(path) as book:
                    root = ET.fromstring(book.read("xl/workbook.xml"))
                found += [
                    (place, path, number, element.get("name"))
                    for number, element in enumerate(e for e in root.iter() if e.tag.endswith("}sheet"))
                ]
            yield pd.DataFrame(found, columns=["place", "path", "number", "sheet"])

    return listed


def _sheet_reader(chunk: int = 10_000):
    """Task side: rows of text cells of every listed sheet; row 0 is the header row."""
    archive = _archive_opener()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import re
        from datetime import datetime, timedelta
        from xml.etree import ElementTree as ET

        def local(element) -> str:
            return element.tag.rsplit("}", 1)[-1]

        def texts(element) -> str:
            """Text of a string item, without phonetic guides."""
            if local(element) == "rPh":
                return ""
            return (element.text or "" if local(element) == "t" else "") + "".join(texts(e) for e in element)

        def shared_strings(book) -> list[str]:
            if "xl/sharedStrings.xml" not in book.namelist():
                return []
            out = []
            with book.open("xl/sharedStrings.xml") as part:
                for _, element in ET.iterparse(part):
                    if local(element) == "si":
                        out.append(texts(element))
                        element.clear()
            return out

        def date_styles(book) -> set[int]:
            """Cell formats that show a number as a date or time."""
            if "xl/styles.xml" not in book.namelist():
                return set()
            root = ET.fromstring(book.read("xl/styles.xml"))
            dated = {*range(14, 23), *range(45, 48)}
            for element in root.iter():
                if local(element) == "numFmt":
                    code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", element.get("formatCode", "")).lower()
                    if re.search(r"[ymdhs]", code):
                        dated.add(int(element.get("numFmtId")))
            formats = next((e for e in root.iter() if local(e) == "cellXfs"), [])
            return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId", 0)) in dated}

        def sheet_part(book, number: int) -> tuple[str, bool]:
            root = ET.fromstring(book.read("xl/workbook.xml"))
            sheet = [e for e in root.iter() if local(e) == "sheet"][number]
            link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            links = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
            target = next(e.get("Target") for e in links if e.get("Id") == link).lstrip("/")
            from_1904 = any(local(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
            return (target if target.startswith("xl/") else f"xl/{target}"), from_1904

        def number_text(raw: str, dated: bool, epoch: datetime) -> str:
            value = float(raw)
            if dated:
                moment = epoch + timedelta(seconds=round(value * 86400))
                if value < 1:
                    return moment.strftime("%H:%M:%S")
                midnight = (moment.hour, moment.minute, moment.second) == (0, 0, 0)
                return moment.strftime("%Y-%m-%d" if midnight else "%Y-%m-%d %H:%M:%S")
            return str(int(value)) if value == int(value) else repr(value)

        def cell_value(cell, strings, dates, epoch) -> str | None:
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                return "".join(texts(e) for e in cell) or None
            raw = next((e.text for e in cell if local(e) == "v"), None)
            if raw is None or kind == "e":
                return None
            if kind == "s":
                return strings[int(raw)]
            if kind == "b":
                return "True" if raw == "1" else "False"
            if kind == "n":
                return number_text(raw, int(cell.get("s", 0)) in dates, epoch)
            return raw

        def column_number(reference: str) -> int:
            number = 0
            for letter in reference:
                if letter.isdigit():
                    break
                number = number * 26 + ord(letter) - 64
            return number - 1

        def rows_of(book, number: int):
            part_name, from_1904 = sheet_part(book, number)
            strings, dates = shared_strings(book), date_styles(book)
            epoch = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
            expected = 1
            with book.open(part_name) as part:
                for _, element in ET.iterparse(part):
                    if local(element) != "row":
                        continue
                    at = int(element.get("r", expected))
                    cells: list[str | None] = []
                    for cell in element:
                        index = column_number(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (index - len(cells))
                        cells.append(cell_value(cell, strings, dates, epoch))
                    if any(c is not None for c in cells):
                        # blank rows count only when a filled row follows them
                        yield from ([] for _ in range(at - expected))
                        yield cells
                        expected = at + 1
                    element.clear()

        for batch in batches:
            for place, path, number in zip(batch["place"], batch["path"], batch["number"]):
                out, header_id = [], ""
                with archive(path) as book:
                    for row_no, cells in enumerate(rows_of(book, number)):
                        if row_no == 0:
                            header_id = hashlib.md5(repr(cells).encode()).hexdigest()
                        out.append((place, row_no, header_id, cells))
                        if len(out) == chunk:
                            yield pd.DataFrame(out, columns=["place", "row_no", "header_id", "cells"])
                            out = []
                if out:
                    yield pd.DataFrame(out, columns=["place", "row_no", "header_id", "cells"])

    return read


def list_sheets(spark: SparkSession, files: list[str]) -> list[tuple[int, str, int, str]]:
    """(place, file, sheet number, sheet) of every sheet, in order; read on the executors."""
    books = spark.createDataFrame(list(enumerate(files)), "place int, path string")
    tasks = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    listed = books.repartition(tasks, "place").mapInPandas(_sheet_lister(), SHEETS)
    found = sorted((r["place"], r["number"], r["path"], r["sheet"]) for r in listed.toLocalIterator())
    return [(place, path, number, sheet) for place, (_, number, path, sheet) in enumerate(found)]


def scan_workbooks(spark: SparkSession, paths: list[str], sheets: str = "all") -> WorkbookScan:
    """Tables of the workbooks behind ``paths``.

    With ``sheets="first"`` a source is a file, otherwise a sheet (named
    ``file/sheet`` when there are several files).
    """
    files = discover_tables(spark, paths, ("xlsx",))
    listed = list_sheets(spark, files)
    if sheets == "first":
        listed = [row for row in listed if row[2] == 0]
    names = {}
    for place, path, _, sheet in listed:
        file = path.rsplit("/", 1)[-1]
        names[place] = file if sheets == "first" else sheet if len(files) == 1 else f"{file}/{sheet}"
    tasks = max(1, min(len(listed), spark.sparkContext.defaultParallelism * 16))
    wanted = spark.createDataFrame(listed, SHEETS).repartition(tasks, "place")
    rows = stage(wanted.mapInPandas(_sheet_reader(), ROWS), "workbook")

    heads = rows.filter("row_no = 0").select("place", "header_id", "cells")
    filled = {r["place"] for r in rows.filter("row_no > 0").select("place").distinct().toLocalIterator()}
    by_header: dict[str, tuple[list, dict[int, str]]] = {}
    for row in sorted(heads.toLocalIterator(), key=lambda r: r["place"]):
        if row["place"] in filled:
            members = by_header.setdefault(row["header_id"], (row["cells"], {}))[1]
            members[row["place"]] = names[row["place"]]
    groups = [_sheet_group(spark, rows, header_id, cells, members) for header_id, (cells, members) in by_header.items()]
    return WorkbookScan(groups, [names[p] for p in sorted(names) if p not in filled])


def _sheet_group(spark, rows, header_id: str, cells: list, members: dict[int, str]) -> HeaderGroup:
    headers = clean_headers([c or "" for c in cells])
    sources = spark.createDataFrame(list(members.items()), f"place int, {SOURCE} string")
    data = rows.filter((F.col("header_id") == header_id) & (F.col("row_no") > 0)).join(sources, "place")
    table = data.select(
        *[null_tokens(F.get("cells", F.lit(i))).alias(h) for i, h in enumerate(headers)],
        F.col(SOURCE),
        F.col("place").alias(ORDER),
        (F.shiftleft(F.col("place").cast("bigint"), FILE_BITS) + F.col("row_no")).alias(ROW_ID),
    )
    table = table.select(*[named(c) for c in table.columns])
    return HeaderGroup(normalize_text_columns(table), tuple(headers), tuple(members.items()))

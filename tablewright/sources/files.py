"""Scans of one table or of many tables with differing headers."""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.constants import NA_TOKENS
from tablewright.functions.names import named
from tablewright.operators.identity import FILE_BITS, MONOTONIC_BITS, ROW_ID
from tablewright.operators.merge import ORDER, SOURCE, HeaderGroup
from tablewright.operators.schema import distinct_headers, normalize_header, normalize_text_columns
from tablewright.sources.records import first_records, split_records

SUFFIXES = ("csv", "parquet")
#: files of one scan: their order (a path and an int each, a few MB) is what the scan broadcasts; more files are more scans
SCAN_FILES = 20_000


def _depth(path: str) -> int:
    """Folders above the last part of a path, its scheme and authority left out."""
    inner = path.split("://", 1)[-1].split("/", 1)[-1] if "://" in path else path.split(":", 1)[-1].lstrip("/")
    return len([part for part in inner.split("/") if part])


def discover_tables(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Files behind ``paths``: folders are listed one level deep, by lower-case name.

    Missing paths and unknown suffixes are skipped, repeats are dropped.  The
    listing is what every Spark scan holds on the driver anyway.
    """
    found: dict[str, None] = {}
    any_case = ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix) for suffix in suffixes)
    wildcard = "*.{" + ",".join(any_case) + "}"
    for path in paths:
        try:
            # the content column is pruned: files are listed, not read; without the recursive lookup a folder
            # named like a partition (k=v) would hide the files beside it
            reader = spark.read.format("binaryFile").option("pathGlobFilter", wildcard).option("recursiveFileLookup", "true")
            listing = reader.load(path).select("path")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        deepest = _depth(path) + 1
        files = [row["path"] for row in listing.toLocalIterator() if _depth(row["path"]) <= deepest]
        for file in sorted(files, key=lambda f: (f.rsplit("/", 1)[-1].lower(), f)):
            found[file] = None
    if not found:
        raise ValueError(f"no table found; looked for {', '.join(suffixes)} files")
    return list(found)


def file_format(path: str) -> str:
    return "parquet" if path.lower().endswith(".parquet") else "csv"


def read_headers(spark: SparkSession, files: list[str]) -> list[tuple[int, str, tuple[str, ...]]]:
    """(order, file, headers) per file, by Spark's own readers, so any path they open will do.

    First records of text files are found on the executors; only distinct ones
    and a number for each file come to the driver.  For parquet the headers are
    names, then types: files are scanned together only when both agree.
    """
    texts = [f for f in files if file_format(f) == "csv"]
    found: dict[str, tuple[str, ...]] = {}
    for begin in range(0, len(texts), SCAN_FILES):
        part = texts[begin : begin + SCAN_FILES]
        firsts = first_records(spark, part)
        kinds = {r["signature"]: r["record"] for r in firsts.groupBy("signature").agg(F.min("record").alias("record")).toLocalIterator()}
        cells = {key: tuple(next(csv.reader(io.StringIO(record.removeprefix("\ufeff"), newline="")), [])) for key, record in kinds.items()}
        by_path = {r["path"]: r["signature"] for r in firsts.select("path", "signature").toLocalIterator()}
        found.update((file, cells[by_path[file]]) for file in part if file in by_path)

    def parquet_header(file: str) -> tuple[str, tuple[str, ...]]:
        schema = spark.read.parquet(file).schema
        return file, (*schema.names, *(f.dataType.simpleString() for f in schema.fields))

    with ThreadPoolExecutor(8) as pool:
        found.update(pool.map(parquet_header, (f for f in files if file_format(f) == "parquet")))
    return [(order, file, found.get(file, ())) for order, file in enumerate(files)]


def clean_headers(headers: list[str] | tuple[str, ...]) -> list[str]:
    return distinct_headers([normalize_header(h) for h in distinct_headers(list(headers))])


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def _with_order(rows: DataFrame, files: dict[str, int]) -> DataFrame:
    """``rows`` (_file, ...) with the order of their file; the table joined has at most ``SCAN_FILES`` rows."""
    if len(files) == 1:
        return rows.withColumn(ORDER, F.lit(next(iter(files.values()))))
    spark = rows.sparkSession
    order = spark.createDataFrame(list(files.items()), f"path string, {ORDER} int")
    # the scan reports escaped paths, so both sides are keyed by the reported form
    listed = spark.read.format("binaryFile").load(list(files)).select("path", F.col("_metadata.file_path").alias("_file"))
    return rows.join(F.broadcast(listed.join(F.broadcast(order), "path").select("_file", ORDER)), "_file")


def _no_surplus(record: Column, surplus: Column) -> Column:
    """True; a record with more cells than the header fails the job instead of losing any."""
    told = F.concat(F.lit("a record has more cells than its header; it begins with "), F.substring(record, 1, 200))
    return F.when(surplus.isNotNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True))


def _whole_files(spark: SparkSession, files: list[str], width: int, multi_line: bool) -> DataFrame:
    """Records of text files by Spark's reader: cells c0, c1, … with _name, _file and _place.

    Spark hands over the text of records whose cells don't match the header;
    only those are read once more, with room for one more cell.
    """
    raw = [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    reader = spark.read.schema(T.StructType([*raw, T.StructField("_record", T.StringType())])).option("columnNameOfCorruptRecord", "_record")
    scanned = reader.csv(files, header=True, escape='"', multiLine=multi_line)
    wider = ", ".join(f"c{i} string" for i in range(width + 1))
    surplus = F.from_csv("_record", wider, {"escape": '"'}).getField(f"c{width}")
    # Spark reads the text of records only together with a cell
    begins = F.concat(F.coalesce("c0", F.lit("")), F.lit(": "), F.coalesce("_record", F.lit("")))
    fine = _no_surplus(begins, F.when(F.col("_record").isNotNull(), surplus))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << MONOTONIC_BITS) - 1))
    where = [F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") + inside).alias("_place")]
    return scanned.filter(fine).select(*[f.name for f in raw], *where)


def _cut_files(spark: SparkSession, files: list[str], width: int) -> DataFrame:
    """The same of files that several tasks read, whatever line breaks their cells hold."""
    wider = ", ".join(f"c{i} string" for i in range(width + 1))
    records = split_records(spark, files).where("NOT first")
    parsed = records.withColumn("cells", F.from_csv("record", wider, {"escape": '"', "multiLine": "true"}))
    parsed = parsed.where(_no_surplus(F.col("record"), F.col("cells")[f"c{width}"]))
    return parsed.select(*(F.col("cells")[f"c{i}"].alias(f"c{i}") for i in range(width)), F.col("name").alias("_name"), F.col("path").alias("_file"), F.col("place").alias("_place"))


def _text_rows(spark: SparkSession, files: list[str], width: int, multi_line: bool) -> DataFrame:
    """Text files that make one split are a task each; larger ones are cut, their records put together across the cuts."""
    if not multi_line:
        return _whole_files(spark, files, width, False)
    largest = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    sizes = spark.read.format("binaryFile").load(files).select("path", "length")
    large = {r["path"] for r in sizes.where(F.col("length") > largest).toLocalIterator()}
    parts = []
    if len(large) < len(files):
        parts.append(_whole_files(spark, [f for f in files if f not in large], width, True))
    if large:
        parts.append(_cut_files(spark, [f for f in files if f in large], width))
    return reduce(DataFrame.union, parts)


def _scan_part(spark: SparkSession, headers: tuple[str, ...], files: dict[str, int], multi_line: bool) -> tuple[DataFrame, list[str]]:
    """Rows (cells c0, c1, …, file name, order, row id) of at most ``SCAN_FILES`` files, and the names of the cells."""
    if file_format(next(iter(files))) == "parquet":
        scanned = spark.read.parquet(*files)
        names = clean_headers(scanned.columns)
        where = [F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")]
        rows = scanned.select(*(named(c).alias(f"c{i}") for i, c in enumerate(scanned.columns)), *where)
    else:
        names = clean_headers(headers)
        rows = _text_rows(spark, list(files), len(names), multi_line)
    rows = _with_order(rows, files)
    too_wide = F.raise_error(F.lit("a file is too large, or there are too many files, for row ids of 63 bits"))
    fits = (F.col("_place") < F.lit(1 << FILE_BITS)) & (F.col(ORDER) < F.lit(1 << (63 - FILE_BITS)))
    row_id = F.when(fits, F.shiftleft(F.col(ORDER).cast("bigint"), FILE_BITS) + F.col("_place")).otherwise(too_wide.cast("bigint"))
    cells = [F.col(f"c{i}") for i in range(len(names))]
    cells = [null_tokens(c) if isinstance(rows.schema[f"c{i}"].dataType, T.StringType) else c for i, c in enumerate(cells)]
    return rows.select(*(c.alias(n) for c, n in zip(cells, names)), F.col("_name").alias(SOURCE), F.col(ORDER), row_id.alias(ROW_ID)), names


def scan_group(
    spark: SparkSession, headers: tuple[str, ...], files: dict[str, int], multi_line: bool = True
) -> HeaderGroup:
    """The rows of all files that share a header row, however many.

    Cells may hold line breaks; ``multi_line=False``, for files known to hold
    none, spares the look for them.  Records end in a line feed, with or without
    a carriage return; files with carriage returns alone have to be of one split.

    ``_row_id`` is file order and place inside the file.  For parquet the place
    is the row index.  For text it is the byte offset of the split plus the row
    number inside the partition: a partition never holds more rows than bytes,
    and splits of one file lie at least a partition's bytes apart.
    """
    listed = list(files.items())
    parts = [_scan_part(spark, headers, dict(listed[i : i + SCAN_FILES]), multi_line) for i in range(0, len(listed), SCAN_FILES)]
    rows, names = reduce(DataFrame.union, (part for part, _ in parts)), parts[0][1]
    sources = tuple(sorted((order, file.rsplit("/", 1)[-1]) for file, order in files.items()))
    return HeaderGroup(normalize_text_columns(rows), tuple(names), sources)


def scan_many(spark: SparkSession, files: list[str], multi_line: bool = True) -> list[HeaderGroup]:
    """One scan per distinct header row, however many files there are; empty files are left out."""
    if len(files) == 1 and file_format(files[0]) == "parquet":
        return [scan_group(spark, (), {files[0]: 0})]
    by_header: dict[tuple, dict[str, int]] = {}
    for order, file, headers in read_headers(spark, files):
        if headers:
            by_header.setdefault((file_format(file), headers), {})[file] = order
    return [scan_group(spark, headers, members, multi_line) for (_, headers), members in by_header.items()]


def scan_table(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One table from a file or a folder of equally headed files, with ``_row_id`` and ``_source_file``."""
    groups = scan_many(spark, discover_tables(spark, [path]), multi_line)
    if not groups:
        raise ValueError("the table is empty")
    if len(groups) > 1:
        raise ValueError("the files have different headers; use scan_many")
    rows, headers = groups[0].rows.drop(ORDER), groups[0].headers
    if len(headers) == 1 and headers[0].startswith("Unnamed"):
        raise ValueError("no header row found")
    if rows.isEmpty():
        raise ValueError("the table is empty")
    return rows

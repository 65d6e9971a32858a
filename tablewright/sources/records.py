"""Records of quoted text files that many tasks read at once.

A cell may hold line breaks if it is quoted, so whether a line begins inside a
cell depends on all lines before it.  Of one line only its effect matters.
Doubled quotes change nothing; of what is left, a quote after a comma or at the
beginning of the line opens a cell if none is open, and any quote closes an open
one.  Hence a line with another quote than those leaves a state that does not
depend on the one before (``OUT``, ``IN``); any other line keeps it (``KEEP``)
or turns it round (``TURN``).

Effects are folded in runs of lines and runs in splits: arrays of ``RUN`` lines
and of the runs of a split; splits are followed through a file by a window.  Then
each split knows how it begins, and its task puts the lines of its own records
together in one pass, without shuffling any text.  Only records that a cut runs
through (a piece at each end of a split) are joined by a shuffle.  Tasks read
several splits where those are small, so small splits aren't as many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.identity import MONOTONIC_BITS
from tablewright.operators.staging import stage

KEEP, TURN, OUT, IN = range(4)
RUN = 12  # bits of lines whose effects are folded together
TASK_BYTES = 128 << 20  # text that one task reads, in splits of at most that
TASKS = 16  # tasks for each core that a read has at least, if it has as many splits

PIECES = "name string, path string, block bigint, at bigint, kind int, first boolean, record string"
WHOLE, HEAD, MIDDLE, TAIL = range(4)


def effect(line: Column) -> Column:
    """What a line does to the state it begins in."""
    opener = "\x01"
    marks = F.replace(F.replace(line, F.lit(opener), F.lit("")), F.lit('""'), F.lit(""))
    marks = F.replace(F.concat(F.lit(","), marks), F.lit(',"'), F.lit(opener))
    behind = F.substring_index(marks, '"', -1)  # all of it if no other quote is there
    turns = (F.length(behind) - F.length(F.replace(behind, F.lit(opener), F.lit("")))) % 2
    fixed = F.when(turns == 1, F.lit(IN)).otherwise(F.lit(OUT))
    found = F.when(F.contains(marks, F.lit('"')), fixed).otherwise(F.when(turns == 1, F.lit(TURN)).otherwise(F.lit(KEEP)))
    return F.when(F.contains(line, F.lit('"')), found).otherwise(F.lit(KEEP))


def _then(first: Column, second: Column) -> Column:
    """The effect of one after the other."""
    turned = F.when(first == KEEP, TURN).when(first == TURN, KEEP).when(first == OUT, IN).otherwise(OUT)
    return F.when(second == KEEP, first).when(second == TURN, turned).otherwise(second)


def _folded(parts: Column) -> Column:
    """The effect of an array of effects in order."""
    return F.aggregate(F.sort_array(parts), F.lit(KEEP), lambda done, x: _then(done, x["effect"]))


def _dealt(spark: SparkSession, rows: DataFrame, files: list[str]) -> DataFrame:
    """``rows`` of ``files`` with splits that are small put together in tasks of ``TASK_BYTES``; each stays whole and in its order."""
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0
    return rows.coalesce(max(TASKS * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def _raw(spark: SparkSession, files: list[str]) -> DataFrame:
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_name", "name"), ("file_path", "path"), ("file_block_start", "block"))]
    return spark.read.option("lineSep", "\n").text(files).select(*meta, F.col("value").alias("line"))


def _placed(read: DataFrame) -> DataFrame:
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << MONOTONIC_BITS) - 1))
    return read.select("name", "path", "block", at.alias("at"), "line", effect(F.col("line")).alias("effect"))


def lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """name, path, block (offset of the split), at (rises in a split), line and effect; a line keeps its carriage return."""
    return _dealt(spark, _placed(_raw(spark, files)), files)


def split_states(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, block, inside, crlf) for every split that holds a line: whether it begins inside a cell, and how the file ends its lines."""
    read = lines(spark, files).select("path", "block", "at", "effect", F.endswith("line", F.lit("\r")).alias("crlf"))
    changes = F.collect_list(F.when(F.col("effect") != KEEP, F.struct("at", "effect")))
    runs = read.groupBy("path", "block", F.shiftright("at", RUN).alias("run")).agg(changes.alias("parts"), F.min_by("crlf", "at").alias("crlf"))
    runs = runs.select("path", "block", "run", _folded(F.col("parts")).alias("effect"), "crlf")
    splits = runs.groupBy("path", "block").agg(F.collect_list(F.struct("run", "effect")).alias("parts"), F.min_by("crlf", "run").alias("crlf"))
    splits = splits.select("path", "block", _folded(F.col("parts")).alias("effect"), "crlf")
    # one row for each split of a file; a state is the last one left for certain, turned round as often as splits since do
    of_file = W.partitionBy("path").orderBy("block")
    before = of_file.rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("turns", F.coalesce(F.sum(F.when(F.col("effect") == TURN, 1)).over(before), F.lit(0)))
    certain = F.when(F.col("effect") == IN, F.col("turns") + 1).when(F.col("effect") == OUT, F.col("turns"))
    since = F.coalesce(F.last(certain, ignorenulls=True).over(before), F.lit(0)) + F.col("turns")
    return splits.select("path", "block", (since % 2 == 1).alias("inside"), F.first("crlf").over(of_file).alias("crlf"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the splits that a task reads, and the pieces of those that a cut runs through."""
    split: tuple = ()
    inside, held, begun, leading, headed, crlf = False, [], 0, False, False, False
    out: list[tuple] = []

    def add(kind: int, at: int) -> None:
        nonlocal headed
        record = "\n".join(held)
        if crlf:  # as the reader of whole files takes them
            record = record.replace("\r\n", "\n").removesuffix("\r")
        elif kind in (WHOLE, TAIL):
            record = record.removesuffix("\r")
        if record or kind != WHOLE:  # empty lines are no records
            first = split[2] == 0 and not headed
            headed = True
            out.append((split[0], split[1], split[2], at, kind, first, record))

    def closed() -> None:
        if held:
            add((MIDDLE if leading else HEAD) if inside else (TAIL if leading else WHOLE), begun)

    def flushed() -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in PIECES.split(", ")])

    for batch in batches:
        for name, path, block, at, line, change, starts_inside, ends_so in zip(*(c.to_pylist() for c in batch.columns)):
            if split != (name, path, block):
                closed()
                split, inside, held, leading, headed, crlf = (name, path, block), starts_inside, [], starts_inside, False, ends_so
            if not held:
                begun = at
            held.append(line)
            inside = inside if change == KEEP else (not inside if change == TURN else change == IN)
            if not inside:
                add(TAIL if leading else WHOLE, begun)
                held, leading = [], False
        yield flushed()
    closed()
    yield flushed()


def split_records(spark: SparkSession, files: list[str], only_first: bool = False) -> DataFrame:
    """name, path, place (rises in a file), first (of its file) and record, of files cut into any splits.

    Empty lines are no records.  What is left open at the end of a file is a
    record of its own.  The text is read twice, and its records are written once
    for whoever reads the result (with ``only_first``, those few that are asked for).
    """
    # one row for each split, which the scan's own plan holds as well
    states = F.broadcast(stage(split_states(spark, files), "splits"))
    read = lines(spark, files).join(states, ["path", "block"])
    pieces = read.select("name", "path", "block", "at", "line", "effect", "inside", "crlf").mapInArrow(_pieces, PIECES)
    if only_first:
        pieces = pieces.where((F.col("kind") != WHOLE) | F.col("first"))
    pieces = stage(pieces, "pieces")
    # at most two a split; each belongs to the last beginning before it
    cut = _dealt(spark, pieces.where(F.col("kind") != WHOLE), files)
    so_far = W.partitionBy("path").orderBy("block", "at").rowsBetween(W.unboundedPreceding, W.currentRow)
    turns = cut.select("path", "block", "at", F.count_if(F.col("kind") == HEAD).over(so_far).alias("nth"))
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "first", "record")))
    joined = cut.join(turns, ["path", "block", "at"]).groupBy("name", "path", "nth").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["record"]), "\n")
    joined = joined.select("name", "path", *(F.col("parts")[0][c].alias(c) for c in ("block", "at", "first")), text.alias("record"))
    columns = ["name", "path", (F.col("block") + F.col("at")).alias("place"), "first", "record"]
    both = pieces.where(F.col("kind") == WHOLE).select(*columns).union(stage(joined.select(*columns), "joined"))
    # the stages are read in splits as small as the text's
    return _dealt(spark, both, files)


def first_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """path, record and signature of the first record of every file that has any; paths as listed, not as reported."""
    listed = spark.read.format("binaryFile").load(files).select(F.col("path").alias("listed"), F.col("_metadata.file_path").alias("path"))
    read = _dealt(spark, _placed(_raw(spark, files).where((F.col("block") == 0) & (F.rtrim("line", F.lit("\r")) != ""))), files)
    # one row for each file, read several times
    first = stage(read.groupBy("path").agg(F.min_by(F.struct("line", "effect"), "at").alias("top")), "first-lines")
    broken = first.where(F.col("top.effect").isin(TURN, IN)).limit(1).count()
    found = first.select("path", F.regexp_replace("top.line", "\r$", "").alias("record"))
    if broken:  # a header with line breaks in its cells
        found = split_records(spark, files, only_first=True).where("first").select("path", "record")
    found = listed.join(found, "path").select(F.col("listed").alias("path"), "record")
    return found.withColumn("signature", F.xxhash64("record"))

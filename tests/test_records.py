"""Text files cut into many splits give the rows of a reader that takes them whole."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright import discover_tables, scan_many, scan_table
from tablewright.sources import records


def after(line, inside):
    """The state behind a line, one character at a time."""
    at_start, i = True, 0
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
            at_start = False
        elif c == ",":
            at_start = True
        elif c == '"' and at_start:
            inside, at_start = True, False
        else:
            at_start = False
        i += 1
    return inside


def test_effects_of_lines(spark):
    rng = random.Random(1)
    # a quote that closes a cell is followed by its comma or the end of the line
    cells = ["", "a", '"a"', '"a,b"', '"a""b"', 'a"b', '""', '""""', '"a"""', "é", "\x01"]
    tails = ["", '"open', '"open, more', '"open ""x""', '"']
    heads = ["", 'end"', 'x,"', 'x ""y"" "', '"', "on"]
    made = {rng.choice(heads) + rng.choice([",", ""]) + ",".join(rng.choice(cells) for _ in range(rng.randrange(4))) + rng.choice(["", ","]) + rng.choice(tails) for _ in range(400)}
    rows = spark.createDataFrame([(line,) for line in made], "line string").select("line", records.effect(F.col("line")).alias("e")).collect()
    for line, effect in rows:
        if '"""' in line.replace('""""', ""):
            continue
        for inside in (False, True):
            told = {records.KEEP: inside, records.TURN: not inside, records.OUT: False, records.IN: True}[effect]
            if well_formed(line, inside):
                assert told == after(line, inside), (line, inside)


def well_formed(line, inside):
    """Whether no quote stands behind the closing one of a cell and none of a cell is doubled outside."""
    i, at_start, closed = 0, True, False
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside, closed = False, True
            at_start = False
        elif c == ",":
            at_start, closed = True, False
        elif closed:
            return False
        elif c == '"':
            if not at_start:
                return False
            inside, at_start = True, False
        else:
            at_start = False
        i += 1
    return True


def quoted(rng):
    words = ["a", "b\nc", "d\r\ne", 'say "x"', ",", "", "\n\n", '"', '",\n"', "é日", "long " * 30, None]
    cell = rng.choice(words)
    if cell is None:
        return ""
    return '"' + cell.replace('"', '""') + '"' if rng.random() < 0.6 or any(c in cell for c in ',"\n\r') or not cell else cell


@pytest.mark.parametrize("end,seed", [("\n", 3), ("\r\n", 2)])
def test_cut_files_equal_whole_ones(spark, tmp_path, end, seed):
    rng = random.Random(seed)
    for number in range(3):
        lines = ["k,v,w"] + [f"{number}-{i},{quoted(rng)},{quoted(rng)}" for i in range(rng.choice([1, 20]) if number else 60)]
        if number == 2:
            lines.insert(len(lines) // 2, "")
        (tmp_path / f"{number}.csv").write_bytes((end.join(lines) + (end if number else "")).encode())
    (tmp_path / "4.csv").write_bytes(b"k,v,w\n")
    (tmp_path / "5.csv").write_bytes(b'k,v,w\n5,12" pipe,x\n6,a "b" c,y\n7,"' + b"z\n" * 60 + b'",end\n8,,\n')
    whole = [tuple(r)[:3] for r in scan_table(spark, str(tmp_path)).orderBy("_row_id").collect()]
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    cut = scan_table(session, str(tmp_path))
    assert cut.rdd.getNumPartitions() > 40
    rows = cut.orderBy("_row_id").collect()
    assert [tuple(r)[:3] for r in rows] == whole and len({r["_row_id"] for r in rows}) == len(rows)
    assert len(whole) > 60


def test_cut_files_refuse_surplus_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + "1,2\n" * 200 + "3,4,5\n")
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    with pytest.raises(Exception, match="more cells than its header"):
        scan_table(session, str(tmp_path)).collect()


def test_header_with_line_breaks_and_a_folder_like_a_partition(spark, tmp_path):
    (tmp_path / "1.csv").write_text('"first\nname",x\n1,2\n')
    (tmp_path / "2.csv").write_text("﻿y,x\n3,4\n", encoding="utf-8")
    (tmp_path / "3.csv").write_text("")
    (tmp_path / "k=v").mkdir()
    (tmp_path / "k=v" / "n.csv").write_text("z\n9\n")
    files = discover_tables(spark, [str(tmp_path)])
    assert [f.rsplit("/", 1)[-1] for f in files][:2] == ["1.csv", "2.csv"] and not any("k=v" in f for f in files)
    groups = scan_many(spark, files)
    assert [g.headers for g in groups] == [("first name", "x"), ("y", "x")]
    assert [[tuple(r)[:2] for r in g.rows.collect()] for g in groups] == [[("1", "2")], [("3", "4")]]


def test_many_files_are_several_scans(spark, tmp_path, monkeypatch):
    from tablewright.sources import files

    monkeypatch.setattr(files, "SCAN_FILES", 2)
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text(f"k\n{i}\n")
    rows = scan_table(spark, str(tmp_path))
    assert [r.k for r in rows.orderBy("_row_id").collect()] == ["0", "1", "2", "3", "4"]


def test_small_splits_are_few_tasks(spark, tmp_path):
    rng = random.Random(3)
    rows = [f'{i},"{"x" * rng.randrange(60)}\n""{i}"",\n"' for i in range(4000)]
    rows.insert(2000, '-1,"' + "\n".join(["y" * 90] * 400) + '"')  # runs through many splits
    (tmp_path / "a.csv").write_text("k,v\n" + "\n".join(rows) + "\n")
    cut = spark.newSession()
    cut.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    cut.conf.set("spark.sql.files.openCostInBytes", "0")
    file = str(tmp_path / "a.csv")
    assert cut.read.text(file).rdd.getNumPartitions() > 150
    most = records.TASKS * spark.sparkContext.defaultParallelism
    assert records.lines(cut, [file]).rdd.getNumPartitions() <= most
    read = scan_table(cut, file)
    assert read.rdd.getNumPartitions() <= most
    want = spark.read.csv(file, header=True, escape='"', multiLine=True)
    assert [(r.k, r.v) for r in read.orderBy("_row_id").collect()] == [(r.k, r.v) for r in want.collect()]

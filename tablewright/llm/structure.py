"""Repair of the structure of conversations: a rank-convergence parallel Viterbi search for the cheapest edits.

A repaired conversation has role initials ``(s?(ua)+)?``.  Rows are kept (K,
free), reroled to user or assistant (R, 1) or deleted (D, 2; blank rows and
those that repeat an earlier role and text have to be), empty user or assistant
rows are inserted (I, 5), and a truncated row that stays costs 5 more.  The
``audit`` is the string of edits of least cost, the ASCII-least if several are.

Chunks.  All rows are ranked in one order (conversation, turn, role, text) and
cut every ``1 << bits`` ranks, so a conversation of any length is many chunks
and no task holds more than one at a time.

Costs run backward: a vector holds, for each of four states (nothing yet, after
s, after u, after a), the least cost of all that follows.  A chunk doesn't know
the vector at its right end.  Whatever follows, such vectors differ by no more
than ``BOUNDS``, so the chunk starts from four speculative vectors, the extremes
of that range.  If the four results differ only by constants, the chunk has
converged: its choices no longer depend on what follows.  Otherwise fix-up
passes join it with what its right neighbour became, until they do or the
conversation ends.  As neighbours have grown likewise, passes are as many as
the logarithm of the longest row of chunks that don't converge (a run of
truncated rows never does).

Tracing.  With its right vector (up to a constant, which changes no choice) a
chunk runs backward once more and is traced forward from each state it may be
entered in; the exits are stitched along the conversation in the same way.

Null roles and texts count as one space, as the contract says, so such a row is
blank or of no known role; turns without a number come first.  Rows of one turn
are put in order of role, then text; rows that repeat each other are duplicates.
Rows without a conversation id form a conversation of their own.  An empty
table gives an empty result.  Columns besides the four read cannot clash.  Very
long texts stay outside the search; of a row it holds three letters and a
digest.  The digest of a whole repaired conversation is sequential by nature:
its rows pass through one task, one at a time.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.identity import rank_rows
from tablewright.operators.staging import stage

BITS = 12
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: where an inserted or reroled row leads from each state, and its role
ONWARD = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: where a kept row leads, by its initial, from each state
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "x": (None,) * 4}
#: the cost of ending in each state: inserted rows
END = (0, 10, 5, 0)
#: BOUNDS[s][t]: how much more than from t the rest can cost from s, whatever it is.  Inserting leads from any state but
#: the first two to another for 5; after s or a, and at the start, the same rows may follow, but for an s to delete (2)
BOUNDS = ((0, 0, 5, 0), (12, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
Vector = tuple[int, int, int, int]


def _edits(code: str, after: Vector, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost with what follows, letter, next state) of the edits of one row that isn't preceded by an insertion."""
    yield DELETE + after[state], "D", state
    if code != "d":
        extra = TRUNCATED if code.isupper() else 0
        kept = KEPT[code.lower()][state]
        if kept is not None:
            yield extra + after[kept], "K", kept
        yield REROLE + extra + after[ONWARD[state]], "R", ONWARD[state]


@functools.lru_cache(maxsize=50_000)  # vectors less their minimum are few, as they differ by no more than the bounds
def back(code: str, after: Vector) -> tuple[int, Vector]:
    """The vector before a row, from the one after it: its minimum, and the rest above that."""
    row = [min(cost for cost, _, _ in _edits(code, after, state)) for state in range(4)]
    for _ in range(3):  # each insertion leads one state on
        row = [min(row[state], INSERT + row[ONWARD[state]]) for state in range(4)]
    least = min(row)
    return least, tuple(cost - least for cost in row)


@functools.lru_cache(maxsize=200_000)
def forward(code: str, after: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits up to and with a row, and the state they lead to."""
    least, before = back(code, after)
    letters = ""
    while True:
        found = [(letter, onward) for cost, letter, onward in _edits(code, after, state) if cost == least + before[state]]
        if INSERT + before[ONWARD[state]] == before[state]:
            found.append(("I", ONWARD[state]))
        letter, state = min(found)
        letters += letter
        if letter != "I":
            return letters, state


def vectors(codes: str, right: Vector) -> tuple[int, list[Vector]]:
    """The cost of the whole chunk from the least state, and the vectors behind each row, the one before all first."""
    total, found = 0, [right]
    for code in reversed(codes):
        least, vector = back(code, found[-1])
        total += least
        found.append(vector)
    found.reverse()
    return total, found


def speculative(codes: str) -> list[int]:
    """The vectors before a chunk for each extreme vector after it, as a matrix by rows (state before, extreme after)."""
    columns = []
    for extreme in range(4):
        total, found = vectors(codes, tuple(row[extreme] for row in BOUNDS))
        columns.append([total + cost for cost in found[0]])
    return [columns[extreme][state] for state in range(4) for extreme in range(4)]


def traced(codes: str, right: Vector, state: int, last: bool) -> tuple[int, str]:
    """The state a chunk is left in and its audit, for the state it is entered in."""
    _, after = vectors(codes, right)
    letters = []
    for code, vector in zip(codes, after[1:]):
        some, state = forward(code, vector, state)
        letters.append(some)
    if last:
        letters.append("I" * (END[state] // INSERT))
    return state, "".join(letters)


def cost_of(audit: str, codes: str) -> int:
    kept = iter(codes)
    total = 0
    for letter in audit:
        if letter == "I":
            total += INSERT
            continue
        code = next(kept)
        total += DELETE if letter == "D" else (REROLE if letter == "R" else 0) + (TRUNCATED if code.isupper() else 0)
    return total


def _table(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema.names)


def _id_is(other: str = "_id") -> Column:
    return F.col("conv_id").eqNullSafe(F.col(other))


def _beside(df: DataFrame, offset: int, *columns: Column) -> DataFrame:
    """``columns`` of the chunk ``offset`` pieces away, under that chunk's neighbour."""
    return df.select(F.col("conv_id").alias("_id"), (F.col("piece") - offset).alias("_piece"), *columns)


def _with(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other, (F.col("piece") == F.col("_piece")) & _id_is(), "left").drop("_id", "_piece")


def ranked(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = BITS) -> DataFrame:
    """All rows with ``at``, their rank in order of conversation, turn, role and text, and ``piece``, a run of ranks."""
    rows = df.select(
        F.col(f"`{key}`").cast("bigint").alias("conv_id"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))),
    )
    # rows that repeat each other are told apart, so that a long run of them can be cut
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "text", "tie"))]
    return rank_rows(rows, order, "at", start=0).drop("tie").withColumn("piece", F.shiftright("at", bits))


def chunks(rows: DataFrame) -> DataFrame:
    """Per conversation and piece: its rows' initials, faults and digests, and whether chunks stand before and after it."""
    solid = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(solid == "", "b").when(F.substring(solid, -1, 1).isin(".", "!", "?"), ".").otherwise("t")
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    same = F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")))
    row = F.struct("at", initial.alias("initial"), fault.alias("fault"), same.alias("same"))
    found = rows.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    found = found.select(
        "conv_id",
        "piece",
        F.array_join(F.transform("rows", lambda x: x["initial"]), "").alias("initials"),
        F.array_join(F.transform("rows", lambda x: x["fault"]), "").alias("faults"),
        F.transform("rows", lambda x: x["same"]).alias("same"),
    )
    found = stage(found, "chunks")
    # at most one conversation runs on from a piece to the next
    last = found.groupBy("piece").agg(F.max(F.struct(F.col("conv_id").isNotNull().alias("some"), "conv_id")).alias("end"))
    first_in = found.groupBy("piece").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("some"), "conv_id")).alias("begin"))
    on = last.join(first_in.select((F.col("piece") - 1).alias("piece"), "begin"), "piece").where(F.col("end").eqNullSafe(F.col("begin")))
    on = stage(on.select(F.col("end.conv_id").alias("conv_id"), "piece"), "crossings")
    found = _with(found, _beside(on, 0, F.lit(True).alias("more")))
    found = _with(found, _beside(on, -1, F.lit(True).alias("less")))
    return found.select("*", F.coalesce("less", F.lit(False)).alias("has_prev"), F.coalesce("more", F.lit(False)).alias("has_next")).drop("less", "more")


def _seen(found: DataFrame) -> DataFrame:
    """``found`` with the digests that earlier chunks of the conversation hold."""
    wide = found.where("has_prev OR has_next").select("conv_id", "piece", F.explode(F.array_distinct("same")).alias("one"))
    first = wide.groupBy("conv_id", "one").agg(F.min("piece").alias("first"))
    first = first.select(F.col("conv_id").alias("_id"), F.col("one").alias("_one"), "first")
    again = wide.join(first, (F.col("one") == F.col("_one")) & _id_is()).where(F.col("piece") > F.col("first"))
    again = again.groupBy("conv_id", "piece").agg(F.collect_list("one").alias("seen"))  # at most as many as a chunk has rows
    return _with(found, _beside(again, 0, F.col("seen")))


JUDGED = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64()), ("has_prev", pa.bool_()), ("has_next", pa.bool_()), ("initials", pa.string()), ("codes", pa.string())]
    + [(name, pa.int64()) for name in ("blank", "duplicate", "truncated", "illegal")]
)


def judged(found: DataFrame) -> DataFrame:
    """Chunks with a code for each row (its initial, a capital if truncated, or d for one to delete) and counts of faults."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in JUDGED]
            for conv_id, piece, has_prev, has_next, initials, faults, same, seen in zip(*(c.to_pylist() for c in batch.columns)):
                known, codes = set(seen or ()), []
                counts = dict.fromkeys("bdt.", 0)
                for initial, fault, one in zip(initials, faults, same):
                    if fault != "b" and one in known:
                        fault = "d"
                    known.add(one)
                    counts[fault] += 1
                    codes.append("d" if fault in "bd" else initial.upper() if fault == "t" else initial)
                illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
                values = (conv_id, piece, has_prev, has_next, initials, "".join(codes), counts["b"], counts["d"], counts["t"], illegal)
                for column, value in zip(out, values):
                    column.append(value)
            yield _table(out, JUDGED)

    schema = "conv_id bigint, piece bigint, has_prev boolean, has_next boolean, initials string, codes string, "
    columns = _seen(found).select("conv_id", "piece", "has_prev", "has_next", "initials", "faults", "same", "seen")
    return columns.mapInArrow(run, schema + "blank bigint, duplicate bigint, truncated bigint, illegal bigint")


def _mapped(df: DataFrame, fn, schema: str, types: list[pa.DataType]) -> DataFrame:
    """Rows of ``fn(*row)`` for each row; the first two columns, a chunk's place, stay."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [fn(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            made = [pa.array([r[i] for r in results], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

    return df.mapInArrow(run, schema)


def stitched(found: DataFrame, joined, settled: Column, label: str) -> DataFrame:
    """Chunks (conv_id, piece, own, target) whose ``own`` is joined with that of the chunk ``target`` until all are settled.

    A chunk without target is settled.  ``target`` moves to the target's own, so distances double.
    """
    state = stage(found.withColumn("done", F.col("target").isNull() | settled), label)
    while state.where("NOT done").limit(1).count():
        other = state.select(F.col("conv_id").alias("_id"), F.col("piece").alias("_piece"), F.col("own").alias("theirs"), F.col("target").alias("further"))
        open_ones = state.where("NOT done").join(other, (F.col("target") == F.col("_piece")) & _id_is())
        moved = open_ones.select("conv_id", "piece", joined(F.col("own"), F.col("theirs")).alias("own"), F.col("further").alias("target"))
        moved = moved.withColumn("done", F.col("target").isNull() | settled)
        state = stage(state.where("done").unionByName(moved), label)
    return state


def _product(a: Column, b: Column) -> Column:
    """The (min, +) product of two matrices of four by four, by rows."""
    return F.array(*(F.least(*(a[4 * s + k] + b[4 * k + t] for k in range(4))) for s in range(4) for t in range(4)))


def right_vectors(wide: DataFrame) -> DataFrame:
    """(conv_id, piece, right): the vector behind each chunk of ``wide`` that has a next, less its minimum."""

    def run(has_next: bool, codes: str) -> tuple[list[int]]:
        if has_next:
            return (speculative(codes),)
        total, found = vectors(codes, END)
        return ([total + cost for cost in found[0] for _ in range(4)],)

    own = _mapped(wide.select("conv_id", "piece", "has_next", "codes"), run, "conv_id bigint, piece bigint, own array<bigint>", [pa.list_(pa.int64())])
    own = _with(own, _beside(wide, 0, F.col("has_next"))).withColumn("target", F.when(F.col("has_next"), F.col("piece") + 1)).drop("has_next")
    m = F.col("own")
    parallel = functools.reduce(
        lambda x, y: x & y, (m[4 * s + t] - m[t] == m[4 * s] - m[0] for s in range(1, 4) for t in range(1, 4))
    )
    done = stitched(own, _product, parallel, "vectors")
    before = F.array(*(m[4 * s] for s in range(4)))
    least = F.array_min(before)
    return _beside(done, 1, F.transform(before, lambda x: x - least).alias("right"))


def entries(exits: DataFrame) -> DataFrame:
    """(conv_id, piece, entry): the state in which each chunk with one before it is entered; ``exits``: by state entered in."""
    own = exits.select("conv_id", "piece", F.col("exits").alias("own"), F.when(F.col("has_prev"), F.col("piece") - 1).alias("target"))
    constant = F.size(F.array_distinct("own")) == 1

    def joined(own: Column, theirs: Column) -> Column:
        return F.transform(theirs, lambda state: F.get(own, state))

    done = stitched(own, joined, constant, "entries")
    return _beside(done, -1, F.col("own")[0].alias("entry"))


def solved(found: DataFrame) -> DataFrame:
    """Judged chunks (staged) with ``entry`` (state), ``audit`` and ``cost``."""
    schema = "conv_id bigint, piece bigint, entry int, audit string, cost bigint"
    kinds = [pa.int32(), pa.string(), pa.int64()]

    def alone(codes: str) -> tuple[int, str, int]:
        _, audit = traced(codes, END, START, True)
        return START, audit, cost_of(audit, codes)

    single = _mapped(found.where("NOT has_prev AND NOT has_next").select("conv_id", "piece", "codes"), alone, schema, kinds)

    def from_each(has_prev: bool, has_next: bool, codes: str, right: list[int] | None) -> tuple[list[int], list[str], list[int]]:
        after = tuple(right) if has_next else END
        ways = [traced(codes, after, state if has_prev else START, not has_next) for state in range(4)]
        return [state for state, _ in ways], [audit for _, audit in ways], [cost_of(audit, codes) for _, audit in ways]

    wide = stage(found.where("has_prev OR has_next").select("conv_id", "piece", "has_prev", "has_next", "codes"), "wide")
    ready = _with(wide, right_vectors(wide)).select("conv_id", "piece", "has_prev", "has_next", "codes", "right")
    ways = "conv_id bigint, piece bigint, exits array<int>, audits array<string>, costs array<bigint>"
    ways = _mapped(ready, from_each, ways, [pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())])
    ways = stage(_with(ways, _beside(wide, 0, F.col("has_prev"))), "ways")
    chosen = _with(ways, entries(ways)).withColumn("entry", F.coalesce("entry", F.lit(START)).cast("int"))
    picked = chosen.select("conv_id", "piece", "entry", *(F.get(many, "entry").alias(one) for many, one in (("audits", "audit"), ("costs", "cost"))))
    return single.unionByName(picked)


def _repaired(rows: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """Rows behind the answer of their chunk, dealt out by ``by`` and in order."""
    told = answers.select("conv_id", "piece", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), "entry")
    said = rows.select("conv_id", "piece", "at", "turn", "role", "text", F.lit(None).cast("int").alias("entry"))
    order = [F.col("conv_id").asc_nulls_first(), "piece", "at"]
    return told.unionByName(said).repartition(*by).sortWithinPartitions(*order)


class Replay:
    """Edits of a chunk carried out row by row."""

    def __init__(self, audit: str, entry: int):
        self.letters, self.state = iter(audit), entry
        self.letter = next(self.letters, "")

    def _next(self) -> None:
        self.letter = next(self.letters, "")

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.letter == "I":
            self.state = ONWARD[self.state]
            self._next()
            yield "I", ROLE_OF[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows that stay, up to this one and the insertions behind it."""
        if self.letter != "D":
            if self.letter == "K":
                self.state = KEPT[role[:1]][self.state]
            else:
                self.state = ONWARD[self.state]
                role = ROLE_OF[self.state]
            yield self.letter, role, text
        self._next()
        yield from self.inserted()


def repaired(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, piece, place (order in a piece), edit (K, R or I), turn (null if inserted), role, text."""
    schema = "conv_id bigint, piece bigint, place bigint, edit string, turn bigint, role string, text string"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, place = None, 0
        for batch in batches:
            out = []
            for conv_id, piece, at, turn, role, text, entry in zip(*(c.to_pylist() for c in batch.columns)):
                if at < 0:
                    replay, place = Replay(text, entry), 0
                    made = replay.inserted()
                else:
                    made = replay.row(role, text)
                for edit, role, text in made:
                    out.append((conv_id, piece, place, edit, None if edit == "I" else turn, role, text))
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return _repaired(rows, answers, ["conv_id", "piece"]).mapInArrow(run, schema)


def digests(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256: of ``role:text`` of the repaired rows, joined by line feeds; rows are hashed as they come."""
    names = ["conv_id", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, open_id, digest, audits, begun = None, (), None, [], False

        def closed() -> pa.RecordBatch:
            full = [] if digest is None else [(open_id[0], "".join(audits), digest.hexdigest())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))], names)

        for batch in batches:
            for conv_id, _, at, _, role, text, entry in zip(*(c.to_pylist() for c in batch.columns)):
                if at < 0:
                    if open_id != (conv_id,):
                        yield closed()
                        open_id, digest, audits, begun = (conv_id,), hashlib.sha256(), [], False
                    audits.append(text)
                    replay = Replay(text, entry)
                    made = replay.inserted()
                else:
                    made = replay.row(role, text)
                for _, role, text in made:
                    digest.update((("\n" if begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                    begun = True
        yield closed()

    return _repaired(rows, answers, ["conv_id"]).mapInArrow(run, "conv_id bigint, audit string, repaired_sha256 string")


def faults(rows: DataFrame, found: DataFrame, answers: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal and cost."""
    turns = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    turns = turns.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"))
    ends = _with(found, _beside(found.where("has_next"), -1, F.substring("initials", -1, 1).alias("before")))
    crossing = F.concat("before", F.substring("initials", 1, 1))
    ends = ends.withColumn("illegal", F.col("illegal") + F.coalesce((~crossing.isin("su", "ua", "au")).cast("bigint"), F.lit(0)))
    sums = ends.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    costs = answers.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
    for other in (sums, costs):
        turns = turns.join(other.withColumnRenamed("conv_id", "_id"), _id_is()).drop("_id")
    return turns


def report(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = BITS) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    rows = ranked(df, key, turn, role, text, bits)
    found = stage(judged(chunks(rows)), "judged")
    answers = stage(solved(found), "answers")
    hashed = digests(rows, answers).withColumnRenamed("conv_id", "_id")
    return faults(rows, found, answers).join(hashed, _id_is()).drop("_id")


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of the repaired conversations, as ``repaired`` gives them."""
    rows = ranked(df, key, turn, role, text, bits)
    return repaired(rows, stage(solved(stage(judged(chunks(rows)), "judged")), "answers"))

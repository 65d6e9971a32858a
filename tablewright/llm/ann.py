"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search on it.

Vectors.  Equal vectors count once, under their smallest id; the ``k + 1``
smallest ids of each are kept aside and put back into the answers, so ties go
to the smaller id however many copies a vector has.

Graph.  Every vector starts with its best neighbours among those on the same
side of a few random hyperplanes, drawn ``TREES`` times; comparing whole groups
costs less than the rounds it saves.  Then neighbours of neighbours meet: for each
centre, the vectors it lists and those that list it are compared with each
other, and each keeps the ``neighbours`` nearest it has ever seen.  Only pairs
with an edge that is new since the last round meet again.  Of the vectors that
list a centre about ``REVERSE`` meet there, drawn anew each round, as NN-descent
does; so a centre that a third of all rows list is no larger than others.
Rounds go on until fewer than one edge in a thousand changes.  Distances while
building come from float32 copies in units of the median length, and are
doubles; answers never do.

Search.  A query holds a beam of the ``beam`` nearest vectors it has seen.
Each round it visits all neighbours (its own and about ``REVERSE`` of those that
list it) of those in the beam it hasn't asked yet, until none is left; visits of all queries are dealt out
by the place of the visited vector, so a query travels once to each bucket it
visits.  There it goes on along the neighbours that lie in the same bucket until
the nearest ``beam`` of what it found there have been asked.  A query starts from the nearest of
``PIVOTS`` fixed vectors, and from its own node if the index has its vector.
Scores of answers are Euclidean distances of the original vectors in double
precision.

Recall.  Up to ``SAMPLE`` of the queries are compared with all rows and searched
with beams of ``BEAM``, twice that, and so on (widths up to ``TOGETHER`` in one search), until ``TARGET`` of their true
neighbours is found; all queries are then searched with that beam, so its width
follows from the table.  If a beam as wide as the index falls short (parts of
the graph that no way joins), every query is compared with every row instead.

Vectors that are null, empty, zero, or hold null, NaN or infinite components
take no part, nor do vectors whose number of dimensions is not the commonest
one.  Fewer candidates than k give all that were found.  An empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.topk import usable
from tablewright.operators.staging import stage

NEIGHBOURS = 20
#: the first beam tried
BEAM = 16
REVERSE = 300
#: queries compared with all rows in one pass
PASS = 4_096
SAMPLE = 128
#: beams up to this width are tried in one search of the sample, wider ones alone
TOGETHER = 128
TARGET = 0.95
LEAF = 1_024
TREES = 12
PIVOTS = 256
BUCKET = 4_096


def vectors(rows: DataFrame, dims: int | None = None) -> DataFrame:
    """The rows (vec_id, vector) that take part, components as doubles."""
    rows = rows.where("vec_id IS NOT NULL").where(usable(F.col("vector"))).where(F.exists("vector", lambda x: x != 0))
    rows = rows.select("vec_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    if dims is None:
        common = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        dims = common["dims"] if common else 0
    return rows.where(F.size("vector") == dims)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """The rows of a column of packed vectors."""
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal leading columns, over batches sorted by them."""
    place, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[:keys] != place:
                if rows:
                    yield place, rows
                place, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield place, rows


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """member, new, reach and packed vectors of each centre, as arrays, over batches sorted by centre."""
    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)] + [_matrix(batch.column(4), "<f4")]
            rows = [np.concatenate(parts) for parts in zip(held, rows)] if held else rows
            starts = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist()]
            for a, b in zip(starts, starts[1:]):
                yield tuple(r[a:b] for r in rows[1:])
            held = [r[starts[-1] :] for r in rows]
    if held:
        yield tuple(held[1:])


def _distances(x: np.ndarray) -> np.ndarray:
    """Squared distances between all rows of a small matrix; infinite on the diagonal."""
    squares = (x * x).sum(axis=1)
    found = squares[:, None] + squares[None, :] - 2 * x @ x.T
    np.fill_diagonal(found, np.inf)
    return np.maximum(found, 0)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean length of every row, also where squares would leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        far = np.sqrt((x * x).sum(axis=1))
    odd = np.flatnonzero(~((far > 1e-140) & (far < 1e150)))
    if len(odd):
        # powers of two, which round nothing
        unit = np.ldexp(1.0, np.frexp(np.abs(x[odd]).max(axis=1, initial=0))[1] - 1)
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            far[odd] = unit * np.sqrt(((x[odd] / unit[:, None]) ** 2).sum(axis=1))
    return far


def _packed(column: pa.Array) -> np.ndarray:
    """The rows of a column of packed float32 vectors as doubles, whose squares hold whatever their lengths."""
    return _matrix(column, "<f4").astype(np.float64)


def _lists(ids: np.ndarray, sizes: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """id, near, far and, if given, fresh: the first ``sizes[0]`` values belong to the first id, and so on."""
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["id", "near", "far", "fresh"][: len(lists) + 1])


def _nearest_of(own: np.ndarray, to: np.ndarray, far: np.ndarray, fresh: np.ndarray, keep: int) -> pa.RecordBatch:
    """Per id the ``keep`` nearest of its edges; of an edge met twice the one known before counts."""
    order = np.lexsort((far, fresh, to, own))
    own, to, far, fresh = own[order], to[order], far[order], fresh[order]
    single = np.ones(len(own), bool)
    single[1:] = (own[1:] != own[:-1]) | (to[1:] != to[:-1])
    own, to, far, fresh = own[single], to[single], far[single], fresh[single]
    order = np.lexsort((to, far, own))
    own, to, far, fresh = own[order], to[order], far[order], fresh[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(own)))
    kept = np.arange(len(own)) - np.repeat(starts, sizes) < keep
    return _lists(own[starts], np.minimum(sizes, keep), to[kept], far[kept], fresh[kept])


LISTS = "id bigint, near array<bigint>, far array<double>"


def first_lists(packed: DataFrame, n: int, dims: int, keep: int, trees: int) -> DataFrame:
    """Each vector's nearest among those on its side of some random hyperplanes, in groups of about ``LEAF``, ``trees`` times."""
    bits = int(np.ceil(np.log2(n / LEAF))) if n > 2 * LEAF else 0
    planes = [np.random.default_rng(1000 + tree).standard_normal((dims, bits)) for tree in range(trees)]

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _packed(batch.column(1))
                for tree, plane in enumerate(planes):
                    code = ((x @ plane) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x))
                    places = [pa.array(np.full(len(x), tree, np.int32)), pa.array(code.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], *places], ["id", "packed", "tree", "leaf"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):
            ids = np.array([r[0] for r in rows], np.int64)
            if len(ids) > 1:
                far = _distances(_packed(pa.array([r[1] for r in rows], pa.binary())))
                k = min(keep, len(ids) - 1)
                best = np.argpartition(far, k - 1, axis=1)[:, :k]
                yield _lists(ids, np.full(len(ids), k), ids[best].ravel(), np.take_along_axis(far, best, 1).ravel())

    placed = packed.mapInArrow(side, "id bigint, packed binary, tree int, leaf bigint")
    parts = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))
    part = F.pmod(F.xxhash64("id", "tree"), F.col("parts")).alias("part")
    dealt = placed.join(parts, ["tree", "leaf"]).select("tree", "leaf", part, "id", "packed").repartition("tree", "leaf", "part")
    return dealt.sortWithinPartitions("tree", "leaf", "part", "id").mapInArrow(meet, LISTS)


def merged(lists: DataFrame, keep: int) -> DataFrame:
    """Per id the ``keep`` nearest of all its lists; edges known before stay known (not ``fresh``): id, near, far, fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)]
        for batch in batches:
            if batch.num_rows:
                sizes = batch.column(1).value_lengths().to_numpy()
                own = np.repeat(batch.column(0).to_numpy(), sizes)
                to, far = (batch.column(i).flatten().to_numpy() for i in (1, 2))
                fresh = np.repeat(batch.column(3).to_numpy(zero_copy_only=False), sizes)
                held = [np.concatenate(x) for x in zip(held, (own, to, far, fresh))]
                # the last id may go on in the next batch
                end = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
                if end:
                    yield _nearest_of(*(x[:end] for x in held), keep)
                    held = [x[end:] for x in held]
        if len(held[0]):
            yield _nearest_of(*held, keep)

    placed = lists.select("id", "near", "far", "fresh").repartition("id").sortWithinPartitions("id")
    return placed.mapInArrow(run, f"{LISTS}, fresh array<boolean>")


def _centres(graph: DataFrame, step: int) -> DataFrame:
    """centre and members (member, new): all that a centre lists and ``REVERSE`` of those that list it, drawn by ``step``."""
    edges = graph.select("id", F.inline(F.arrays_zip(F.col("near").alias("to"), F.col("fresh").alias("new"))))
    # cut while rows are still where they were, so a centre that many list is no large group
    drawn = F.row_number().over(W.partitionBy("to").orderBy(F.xxhash64("id", "to", F.lit(step)), "id"))
    listing = edges.withColumn("drawn", drawn).where(F.col("drawn") <= REVERSE)
    listing = listing.groupBy(F.col("to").alias("id")).agg(F.collect_list(F.struct(F.col("id").alias("member"), "new")).alias("listing"))
    listed = F.arrays_zip(F.col("near").alias("member"), F.col("fresh").alias("new"))
    both = graph.select("id", listed.alias("listed")).join(listing, "id", "full_outer")
    none = F.array().cast("array<struct<member:bigint,new:boolean>>")
    return both.select(F.col("id").alias("centre"), F.concat(F.coalesce("listed", none), F.coalesce("listing", none)).alias("members"))


def local_join(graph: DataFrame, packed: DataFrame, step: int, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Neighbours of neighbours: what members of each centre find nearer than their farthest neighbour."""
    pairs = _centres(graph, step).where(F.exists("members", lambda m: m["new"])).select("centre", F.inline("members"))
    reach = F.when(F.size("far") >= neighbours, F.array_max("far")).otherwise(F.lit(float("inf")))
    reach = graph.select(F.col("id").alias("member"), reach.alias("reach"))
    payload = packed.select(F.col("id").alias("member"), "packed").join(reach, "member")
    rows = pairs.join(payload, "member").select("centre", "member", "new", "reach", "packed")
    rows = rows.repartition("centre").sortWithinPartitions("centre", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a task finds for one id from many centres is put together before it is shuffled
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            own, to, far = (np.concatenate(x) for x in zip(*found))
            lists = _nearest_of(own, to, far, np.ones(len(own), bool), neighbours)
            return lists.select(["id", "near", "far"])

        for members, fresh, reach, matrix in _met(batches):
            ids, single, place = np.unique(members, return_index=True, return_inverse=True)
            if len(ids) < 2:
                continue
            new = np.zeros(len(ids), bool)
            np.logical_or.at(new, place, fresh)
            far = _distances(matrix[single].astype(np.float64))
            better = (far < reach[single][:, None]) & (new[:, None] | new[None, :])
            if better.sum() > neighbours * len(ids):
                # no more than fit in a list
                far = np.where(better, far, np.inf)
                best = np.argpartition(far, neighbours - 1, axis=1)[:, :neighbours]
                own, to = np.repeat(np.arange(len(ids)), neighbours), best.ravel()
                own, to = own[np.isfinite(far[own, to])], to[np.isfinite(far[own, to])]
            else:
                own, to = np.nonzero(better)
            if len(own):
                found.append((ids[own], ids[to], far[own, to]))
                held += len(own)
            if held >= 1_000_000:
                yield flush()
                found.clear()
                held = 0
        if held:
            yield flush()

    return rows.mapInArrow(run, LISTS)


def neighbour_graph(packed: DataFrame, n: int, dims: int, neighbours: int = NEIGHBOURS, rounds: int | None = None) -> DataFrame:
    """id, near, far, fresh: NN-descent over packed float32 vectors (id, packed)."""
    lists = first_lists(packed, n, dims, neighbours, TREES if n > 2 * LEAF else 1)
    graph = stage(merged(lists.withColumn("fresh", F.lit(True)), neighbours), "graph")
    for step in itertools.count() if rounds is None else range(rounds):
        found = local_join(graph, packed, step, neighbours).withColumn("fresh", F.lit(True))
        known = graph.select("id", "near", "far", F.lit(False).alias("fresh"))
        graph = stage(merged(known.union(found), neighbours), "graph")
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0]
        if not changed or changed < 0.001 * n * neighbours:
            break
    return graph


def adjacency(graph: DataFrame) -> DataFrame:
    """id, the ids it lists and about ``REVERSE`` of those that list it."""
    return _centres(graph, -1).select(F.col("centre").alias("id"), F.array_distinct("members.member").alias("links"))


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of every id, by multiplicative hashing."""
    with np.errstate(over="ignore"):
        mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def placed_nodes(index: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """bucket, id, vector and links of every node, the last two packed."""
    buckets = max(1, n // BUCKET)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # packed once: every round reads all nodes, and unpacking long lists costs more than the distances
        for batch in batches:
            lines = [pa.array([np.array(v or (), t).tobytes() for v in batch.column(i).to_pylist()], pa.binary()) for i, t in ((1, "<f8"), (2, "<i8"))]
            place = pa.array(_bucket(batch.column(0).to_numpy(), buckets))
            yield pa.RecordBatch.from_arrays([place, batch.column(0), *lines], ["bucket", "id", "vector", "links"])

    return stage(index.join(links, "id", "left").select("id", "vector", "links").mapInArrow(pack, "bucket int, id bigint, vector binary, links binary"), "nodes")


def _walk(ids: np.ndarray, matrix: np.ndarray, links: list[bytes], vector: np.ndarray, wanted: np.ndarray, limit: float, beam: int):
    """Rows (of a bucket's sorted ids) visited from the ``wanted`` ones on, and the nearest ``beam`` within ``limit`` with distances."""
    met, asked = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    at = np.searchsorted(ids, wanted)
    known = ids[np.minimum(at, len(ids) - 1)] == wanted
    front, best, far = np.unique(at[known]), np.empty(0, np.int64), np.empty(0)
    while len(front):
        met[front] = True
        d = _lengths(matrix[front] - vector)
        near = d <= limit
        best, far = np.concatenate([best, front[near]]), np.concatenate([far, d[near]])
        first = np.lexsort((ids[best], far))[:beam]
        best, far = best[first], far[first]
        ask = best[~asked[best]]
        asked[ask] = True
        reached = np.frombuffer(b"".join([links[i] for i in ask]), "<i8")
        at = np.minimum(np.searchsorted(ids, reached), len(ids) - 1)
        front = np.unique(at[ids[at] == reached])
        front = front[~met[front]]
    return np.flatnonzero(met), best, far


def search(index: DataFrame, nodes: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """query, ids and distances of the nearest found, nodes visited; ``queries`` (query, vector, own, beam): own is the query's node, if any."""
    buckets = max(1, n // BUCKET)
    # PIVOTS vectors, whatever the size of the index
    fixed = index.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toArrow()
    pivot_ids = fixed["id"].to_numpy()
    pivots = np.array(fixed["vector"].to_pylist(), np.float64)

    trips_type = pa.list_(pa.struct([("bucket", pa.int32()), ("wanted", pa.binary())]))
    state_type = [("query", pa.int64()), ("vector", pa.binary()), ("ids", pa.list_(pa.int64())), ("far", pa.list_(pa.float64()))]
    state_type += [("seen", pa.binary()), ("next", trips_type), ("beam", pa.int32())]
    state_columns = "query bigint, vector binary, ids array<bigint>, far array<double>, seen binary, next array<struct<bucket:int,wanted:binary>>, beam int"

    def trips(wanted: np.ndarray) -> list[dict]:
        """What is to be visited, by bucket."""
        place = _bucket(wanted, buckets)
        order = np.argsort(place, kind="stable")
        where, starts = np.unique(place[order], return_index=True)
        return [{"bucket": int(b), "wanted": w.astype("<i8").tobytes()} for b, w in zip(where, np.split(wanted[order], starts[1:]))]

    def states(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(state_type)], [c for c, _ in state_type])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query, values, own, beam in zip(*(batch.column(i).to_pylist() for i in range(4))):
                vector = np.array(values, "<f8")
                nearest = pivot_ids[np.argsort(_lengths(pivots - vector), kind="stable")[:8]].tolist()
                start = np.array(sorted({*nearest, own} - {None}), np.int64)
                rows.append((query, vector.tobytes(), [], [], b"", trips(start), beam))
            yield states(rows)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 1):
            here = sorted(r[:3] for r in rows if r[0] is not None)
            place = np.array([r[0] for r in here], np.int64)
            matrix = np.frombuffer(b"".join(r[1] for r in here), "<f8").reshape(len(here), -1)
            links = [r[2] for r in here]
            out: list[list] = [[] for _ in range(5)]
            for _, vector, _, asked, wanted, limit, beam in (r for r in rows if r[0] is None and here):
                met, best, far = _walk(place, matrix, links, np.frombuffer(vector, "<f8"), np.frombuffer(wanted, "<i8"), limit, beam)
                for column, value in zip(out, (asked, place[best], far, place[met].astype("<i8").tobytes(), [links[i] for i in best])):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["query", "ids", "far", "seen", "links"])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (asked,), rows in _groups(batches, 1):
            vector, ids, far, seen, following, beam, _ = next(r for r in rows if r[0] is not None)
            known = dict(zip(ids, far))
            links_of: dict[int, bytes] = {}
            past = [seen, *(t["wanted"] for t in following)]
            for _, found, distances, met, _, _, packed in (r for r in rows if r[0] is None):
                known.update(zip(found, distances))
                links_of.update(zip(found, packed))
                past.append(met)
            best = sorted(known.items(), key=lambda x: (x[1], x[0]))[:beam]
            past = np.unique(np.frombuffer(b"".join(past), "<i8"))
            reached = np.unique(np.frombuffer(b"".join(links_of[i] for i, _ in best if i in links_of), "<i8"))
            wanted = np.setdiff1d(reached, past, assume_unique=True)
            out.append((asked, vector, [i for i, _ in best], [d for _, d in best], past.astype("<i8").tobytes(), trips(wanted), beam))
        yield states(out)

    state = stage(queries.select("query", "vector", "own", F.col("beam").cast("int")).mapInArrow(begin, state_columns), "beams")
    null = F.lit(None)
    as_nodes = nodes.select("bucket", "id", "vector", "links", *(null.cast(t).alias(c) for c, t in (("query", "bigint"), ("wanted", "binary"), ("limit", "double"), ("beam", "int"))))
    while True:
        limit = F.when(F.size("far") >= F.col("beam"), F.array_max("far")).otherwise(F.lit(float("inf")))
        asking = state.select("query", "vector", limit.alias("limit"), "beam", F.inline("next"))
        asking = asking.select("bucket", null.cast("bigint").alias("id"), "vector", null.cast("binary").alias("links"), "query", "wanted", "limit", "beam")
        at_place = as_nodes.unionByName(asking).repartition("bucket").sortWithinPartitions("bucket")
        found = at_place.mapInArrow(visit, "query bigint, ids array<bigint>, far array<double>, seen binary, links array<binary>")
        found = found.select("query", null.cast("binary").alias("vector"), "ids", "far", "seen", null.cast(state.schema["next"].dataType).alias("next"), null.cast("int").alias("beam"), "links")
        held = state.withColumn("links", null.cast("array<binary>")).unionByName(found)
        state = stage(held.repartition("query").sortWithinPartitions("query").mapInArrow(advance, state_columns), "beams")
        if not state.where(F.size("next") > 0).limit(1).count():
            return state.select("query", "beam", "ids", "far", (F.octet_length("seen") / 8).cast("bigint").alias("visited"))


def compared(asked: list[tuple[int, np.ndarray]], index: DataFrame, keep: int) -> DataFrame:
    """query, id and far: the nearest ``keep`` of each task's rows, for at most ``PASS`` queries against all rows."""
    numbers, queries = [q for q, _ in asked], [v for _, v in asked]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        for batch in batches:
            if batch.num_rows:
                own, matrix = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.float64)
                for i, vector in enumerate(queries):
                    ids, far = np.concatenate([best[i][0], own]), np.concatenate([best[i][1], _lengths(matrix - vector)])
                    first = np.lexsort((ids, far))[:keep]
                    best[i] = ids[first], far[first]
        for number, (ids, far) in zip(numbers, best):
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), pa.array(ids), pa.array(far)], ["query", "id", "far"])

    found = index.select("id", "vector").mapInArrow(scan, "query bigint, id bigint, far double")
    rank = F.row_number().over(W.partitionBy("query").orderBy("far", "id"))
    return found.withColumn("place", rank).where(F.col("place") <= keep).drop("place")


def _pass_of(queries: DataFrame) -> list[tuple[int, np.ndarray]]:
    """The queries of one pass, at most about ``PASS``."""
    return [(r["query"], np.array(r["vector"], np.float64)) for r in queries.select("query", "vector").collect()]


def recall(found: DataFrame, true: dict[int, list[float]], k: int) -> float:
    """The share of the k nearest other vectors in ``true`` (distances by query) that ``found`` has."""
    hits = 0
    for row in found.select("query", "far").collect():
        want = true.get(row["query"])
        hits += sum(0 < d <= want[-1] for d in row["far"][: k + 1]) if want else 0
    return min(1.0, hits / sum(map(len, true.values()))) if any(true.values()) else 1.0


def found_by_scan(index: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """query, ids and far as ``search`` gives them, from all rows, in passes over the index."""
    passes = -(-queries.count() // PASS)
    parts = []
    for i in range(max(1, passes)):
        asked = _pass_of(queries.where(F.pmod(F.xxhash64("query"), F.lit(max(1, passes))) == i))
        parts.append(stage(compared(asked, index, keep), "scanned"))
    found = functools.reduce(DataFrame.union, parts).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("far", "id"))).alias("hits"))
    return found.select("query", F.col("hits.id").alias("ids"), F.col("hits.far").alias("far"))


def chosen_beam(index: DataFrame, nodes: DataFrame, asked: DataFrame, n: int, k: int, beam: int) -> tuple[int, float, DataFrame | None]:
    """The first of ``beam``, twice that, … that finds ``TARGET`` of a sample's true neighbours, the share it finds, and
    what it finds if the sample is all that is asked."""
    sample = stage(asked.orderBy(F.xxhash64("query"), "query").limit(SAMPLE), "sample")
    drawn, true = _pass_of(sample), dict[int, list[float]]()
    # k + 1 distances of each of at most SAMPLE queries; the query's own vector is no neighbour of it
    for row in compared(drawn, index, k + 1).orderBy("query", "far").collect():
        if row["far"] > 0 and len(true.setdefault(row["query"], [])) < k:
            true[row["query"]].append(row["far"])
    while True:
        # several widths go through the rounds together; a round costs more than a narrow beam's visits
        tried = [beam, *itertools.takewhile(lambda w: w <= TOGETHER and w < 2 * n, (beam << i for i in itertools.count(1)))]
        trials = sample.withColumn("beam", F.explode(F.lit(tried))).withColumn("asked", F.col("query"))
        trials = stage(trials.withColumn("query", F.dense_rank().over(W.orderBy("asked", "beam")).cast("bigint")), "trials")
        found = search(index, nodes, trials, n).join(trials.select("query", "asked"), "query")
        found = stage(found.select(F.col("asked").alias("query"), "beam", "ids", "far", "visited"), "tried")
        for width in tried:
            one = found.where(F.col("beam") == width)
            share = recall(one, true, k)
            if share >= TARGET or width >= n:
                return width, share, one if len(drawn) < SAMPLE else None
        beam = 2 * tried[-1]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, neighbours: int = NEIGHBOURS, rounds: int | None = None, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found among ``rows`` for each of ``queries`` (vec_id, vector).

    ``beam`` is the first width tried, at least k + 1; ``rounds`` ends the building of the graph early.
    """
    used = stage(vectors(rows), "vectors")
    first = used.select(F.size("vector")).first()
    dims = first[0] if first else 0
    same = W.partitionBy("vector").orderBy("vec_id")
    ranked = used.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1)
    copies = stage(ranked.withColumn("id", F.min("vec_id").over(W.partitionBy("vector"))), "copies")
    index = copies.where("copy = 1").select("id", "vector")
    n = index.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.finfo(np.float32).max
        for batch in batches:
            with np.errstate(over="ignore"):
                lines = [np.clip(np.array(v, np.float64) / unit, -most, most) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype("<f4").tobytes() for v in lines], pa.binary())], ["id", "packed"])

    # the median, so that one very long vector doesn't round all others to nothing
    longest = F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    unit = index.agg(F.percentile_approx(longest, 0.5)).first()[0] or 1.0
    packed = stage(index.mapInArrow(pack, "id bigint, packed binary"), "packed")
    graph = neighbour_graph(packed, n, dims, neighbours, rounds)
    own = copies.where("copy = 1").select("id", F.col("vector").alias("own_vector"))
    asked = vectors(queries, dims).join(own, F.col("vector") == F.col("own_vector"), "left")
    asked = asked.select(F.col("vec_id").alias("query"), "vector", F.col("id").alias("own"))
    asked, nodes = stage(asked, "asked"), placed_nodes(index, adjacency(graph), n)
    beam, share, found = chosen_beam(index, nodes, asked, n, k, max(beam, k + 1))
    if share < TARGET:
        found = found_by_scan(index, asked, k + 1)
    elif found is None:
        found = search(index, nodes, asked.withColumn("beam", F.lit(beam)), n)
    hits = found.select("query", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("far").alias("score"))))
    hits = hits.join(copies.select("id", "vec_id"), "id").where("vec_id <> query")
    rank = F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))
    ranked = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")

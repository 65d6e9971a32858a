"""Exact top-k inner products by columnar branch-and-bound.

Vectors lie in blocks, a dimension after the other (vertical layout).  A block
of queries meets a block of rows in one task; products are added up some
dimensions at a time, for all rows of the block at once.  After each step what
is still missing of a row's product is at most the length of the query's
remaining part times the length of the row's (Cauchy-Schwarz on the remaining
mass).  A row whose bound lies below the k-th best product a query already has
for certain is out for that query; rows that are out for all queries leave the
block, and once few pairs are left those go on one by one, compacted after
each step.  What a block returns are each query's k best; the k best of those
are the answer.

The k-th best a query has for certain comes from the full products of the rows
that lead after the first step, and from blocks the same task met before; it
only ever grows.

Rows count with components ``floor(scale * x)``, exact integers.  Vectors that
are null or hold null, NaN or infinite components take no part, nor do rows
without an id; columns besides the two read cannot clash; vectors are
compared with those of the same number of dimensions only, an empty vector
with none.  A row never answers its own id; rows that repeat an id are all
candidates.  Ties go to the smaller id.  Whole components and scores
outside the 64-bit range are the nearest number in it.  Fewer rows than k give all of them; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.staging import stage

STEP = 8  # dimensions added at a time, at least; a quarter of them if that is more
SPARSE = 0.1  # share of (query, row) pairs below which the rest goes pair by pair
PAIRS = 100_000
BLOCK_ROWS = 4_096
BLOCK_QUERIES = 1_024
PASS_BYTES = 64_000_000  # of queries broadcast at once
LEAST, MOST = -(1 << 63), (1 << 63) - 1
EXACT, EXACT_SINGLE = 2.0**53, 2.0**24  # integers up to here are exact in double and single precision


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks (dims, block, ids, values) of (vec_id, vector): ``size`` rows each on average, spread by a hash of the id."""
    counted = rows.withColumn("dims", F.size("vector"))
    counts = counted.groupBy("dims").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    # as many rows as there are different numbers of dimensions
    placed = counted.join(counts, "dims").withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int"))
    # id and vector of a row stay together until the block is whole
    grouped = placed.groupBy("dims", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("rows"))
    return grouped.select("dims", "block", F.col("rows.vec_id").alias("ids"), F.flatten("rows.vector").alias("values"))


def _first_k(query: np.ndarray, row_ids: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, product) the k best of each query, ties to the smaller id."""
    order = np.lexsort((row_ids, -sums, query))
    query, row_ids, sums = query[order], row_ids[order], sums[order]
    starts = np.flatnonzero(np.diff(query, prepend=-1))
    within = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return query[within < k], row_ids[within < k], sums[within < k]


def best_of_block(
    queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, certain: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, product) of the k best of a block (dims x rows) for each query (queries x dims).

    ``certain`` holds the k-th best product each query is sure of; it is raised in place.
    """
    dims, n = columns.shape
    order = np.argsort(-np.abs(columns).sum(axis=1), kind="stable")  # dimensions with most mass first
    kind = np.float32 if np.abs(columns).max() * np.abs(queries).max() * dims < EXACT_SINGLE else np.float64
    columns, queries = columns[order].astype(kind), queries[:, order].astype(kind)
    step = max(STEP, -(-dims // 4))
    ends = [*range(step, dims, step), dims]
    row_squares = np.cumsum(columns[::-1].astype(np.float64) ** 2, axis=0)[::-1]
    own_squares = np.cumsum(queries[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1]
    by_id = np.argsort(ids, kind="stable")
    left, right = (np.searchsorted(ids[by_id], query_ids, side=x) for x in ("left", "right"))
    own = [(q, by_id[i]) for q in np.flatnonzero(right > left) for i in range(left[q], right[q])]
    alive, sums, begin = np.arange(n), None, 0
    for end in ends:
        part = queries[:, begin:end] @ columns[begin:end, alive]
        sums = part if sums is None else sums + part
        if begin == 0:
            for q, i in own:
                sums[q, i] = -np.inf
            if n > 4 * k:
                lead = np.argpartition(-sums, 2 * k, axis=1)[:, : 2 * k]
                full = np.einsum("qd,dqk->qk", queries, columns[:, lead])
                full[np.isneginf(np.take_along_axis(sums, lead, 1))] = -np.inf
                np.maximum(certain, np.partition(full, k, axis=1)[:, k], out=certain)
        begin = end
        if end == dims:
            break
        # half a unit covers rounding of the bounds: products are whole numbers
        bound = np.sqrt(own_squares[:, end]).astype(kind)[:, None] * np.sqrt(row_squares[end, alive]).astype(kind)[None, :]
        possible = sums + bound * kind(1 + 1e-5) >= (certain - 0.5).astype(kind)[:, None]
        if possible.mean() < SPARSE:
            query, row = np.nonzero(possible)
            sums, row = sums[query, row].astype(np.float64), alive[row]
            return _sparse_rest(queries, columns, ids, query, row, sums, ends, end, own_squares, row_squares, certain, k)
        used = possible.any(axis=0)
        if used.mean() < 0.9:
            alive, sums = alive[used], sums[:, used]
    if len(alive) > k:
        least = np.partition(sums, len(alive) - k, axis=1)[:, len(alive) - k]
        query, row = np.nonzero((sums >= least[:, None]) & ~np.isneginf(sums))
    else:
        query, row = np.nonzero(~np.isneginf(sums))
    return _first_k(query, ids[alive[row]], sums[query, row].astype(np.float64), k)


def _sparse_rest(queries, columns, ids, query, row, sums, ends, begin, own_squares, row_squares, certain, k):
    """The steps from ``begin`` on for the few pairs (query, row) left, which are compacted after each."""
    for end in (e for e in ends if e > begin):
        more = np.empty(len(query))
        for i in range(0, len(query), PAIRS):
            some = slice(i, i + PAIRS)
            more[some] = np.einsum("pd,dp->p", queries[query[some], begin:end], columns[begin:end, row[some]], dtype=np.float64)
        sums, begin = sums + more, end
        rest = 0 if end == len(columns) else np.sqrt(own_squares[query, end] * row_squares[end, row])
        kept = sums + rest * (1 + 1e-5) >= certain[query] - 0.5
        query, row, sums = query[kept], row[kept], sums[kept]
    return _first_k(query, ids[row], sums, k)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k largest products for each row of ``queries`` (vec_id, vector)."""
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    if scale == 1.0:
        whole = F.transform("vector", lambda x: x.cast("double"))
    taking_part = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    data = stage(in_blocks(rows.where(taking_part).select("vec_id", whole.alias("vector")), BLOCK_ROWS), "row-blocks")
    asked = stage(in_blocks(queries.where(taking_part).select("vec_id", whole.alias("vector")), BLOCK_QUERIES), "query-blocks")
    asked = asked.select("dims", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    size = asked.agg(F.sum((F.size("q_values") + F.size("q_ids")) * 8)).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure: dict[tuple[int, int], np.ndarray] = {}  # of the queries of a pass
        for batch in batches:
            for row in range(batch.num_rows):
                dims, q_block, ids, values, q_ids, q_values = (batch.column(i)[row] for i in range(6))
                n = dims.as_py()
                ids, q_ids = ids.values.to_numpy(), q_ids.values.to_numpy()
                columns = values.values.to_numpy().reshape(-1, n).T
                asked = q_values.values.to_numpy().reshape(-1, n)
                certain = sure.setdefault((n, q_block.as_py()), np.full(len(q_ids), -np.inf))
                if np.abs(columns).max() * np.abs(asked).max() * n >= EXACT:
                    query, vec, score = exact_of_block(asked, q_ids, columns, ids, k)
                else:
                    query, vec, score = best_of_block(asked, q_ids, columns, ids, k, certain)
                score = pa.array([int(s) for s in score.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(vec), score], ["query_id", "vec_id", "score"])

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found = []
    # a stated set of queries against all rows: blocks of rows stay where they are, blocks of queries come to them, a
    # broadcast of about PASS_BYTES (as measured above) at a time; a query is in one pass
    for number in range(passes):
        some = asked.where(F.pmod(F.col("q_block") + F.col("dims"), F.lit(passes)) == number)
        met = data.join(F.broadcast(some), "dims").select("dims", "q_block", "ids", "values", "q_ids", "q_values")
        best = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint").withColumn("rank", rank).where(F.col("rank") <= k)
        best = best.select("query_id", "rank", "vec_id", "score")
        found.append(best if passes == 1 else stage(best, "pass"))
    return reduce(DataFrame.union, found)


def exact_of_block(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with unbounded integers, for components so large that doubles would round the sums."""
    rows = [[int(x) for x in column] for column in columns.T.tolist()]
    found: list[tuple[int, int, int]] = []
    for q, query in enumerate(queries.tolist()):
        whole = [int(x) for x in query]
        sums = [(-min(max(sum(a * b for a, b in zip(whole, row)), LEAST), MOST), int(i)) for row, i in zip(rows, ids) if i != query_ids[q]]
        found += [(q, i, -s) for s, i in sorted(sums)[:k]]
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], object)

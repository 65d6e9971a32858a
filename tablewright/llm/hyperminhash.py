"""Near duplicates by HyperMinHash: compressed registers, banding, estimate, then exact check on whole shingle sets.

Registers.  Every shingle hash falls into one of ``REGISTERS`` buckets; a
bucket keeps its least value, stored as the number of leading zeros and ten
mantissa bits.  A bucket that no shingle falls into takes the least of all
shingles' values under a hash of its own, so two sets agree in a register with
a chance equal to their Jaccard similarity even if they are tiny.

Links.  Documents with equal sets form a class (smallest id first); only one
row of a class goes on.  Rows that share a band meet in a bucket.  First each
row is tried against the hubs of its buckets (a bucket's hub is the row that
meets most others, which in a group of edited copies is close to all of them),
and checked against the hub most similar by estimate.  Those links give
components.  In each bucket that still holds several, the component with most
rows is the pivot, the others' rows are strays.  Strays of a pivot are compared
with all its rows and with each other, in blocks of about ``BLOCK_ROWS`` rows and
``SET_BYTES`` of sets, inside tasks that return only links which join components.  So a group of copies
never becomes rows for all its pairs, yet every pair that shares a bucket is
either in one component already or tested.  A pair is checked on full sets
unless its estimate is five standard deviations below the threshold.

Rows without words (null, empty or blank texts) have an empty set and are
linked with nothing.  Rows that repeat an id are one document: what one of
them is linked with, all are.  Rows without an id are never linked; their
component is null and they are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WORD_PATTERN, keyed_texts, released
from tablewright.llm.components import components
from tablewright.operators.staging import stage

REGISTERS = 160
BAND_ROWS = 5  # 32 bands: a pair at 0.8 shares none with a chance of 3 in a million
MANTISSA = 10
VALUE_BITS = 40
DEVIATIONS = 5.0
BLOCK_BYTES = 1_000_000
SHARES = 1_000  # a class of more than this part of all rows is dealt out; there are fewer of them than this, so they are broadcast
BLOCK_ROWS = 512
SET_BYTES = 8_000_000  # of whole sets in a block of strays, unless one alone has more

_RANDOM = np.random.default_rng(88)
_BYTE = _RANDOM.integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BUCKET_SEEDS = _RANDOM.integers(1, 1 << 63, REGISTERS).astype(np.uint64)
_BAND_WEIGHTS = _RANDOM.integers(1, 1 << 63, BAND_ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE_MASK = np.uint64((1 << VALUE_BITS) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; A-Z count as a-z."""
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.uint64)
    solid = ~_SPACE[flat]
    if not solid.any():
        return [empty] * len(texts)
    begins = np.cumsum(lengths) - lengths
    after_space = np.ones(len(flat), bool)
    after_space[1:] = ~solid[:-1]
    after_space[begins[lengths > 0]] = True
    starts = np.flatnonzero(solid & after_space)
    first = starts[0]
    within = np.arange(first, len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat))))
    within *= solid[first:]
    powers = np.cumprod(np.full(int(within.max()) + 1, _STEP))
    words = mix(np.add.reduceat(_BYTE[flat[first:]] * powers[within], starts - first))
    text_of = np.searchsorted(begins, starts, side="right") - 1
    counts = np.bincount(text_of, minlength=len(texts))
    ends = np.cumsum(counts)
    joined = words.copy()
    if len(words) >= width:
        joined = words[: len(words) - width + 1].copy()
        for i in range(1, width):
            joined = joined * _STEP + words[i : len(words) - width + 1 + i]
        joined = mix(joined)
    found = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if not count:
            found.append(empty)
        elif count < width:
            whole = np.uint64(count)
            with np.errstate(over="ignore"):
                for word in words[end - count : end]:
                    whole = whole * _STEP + word
            found.append(mix(np.array([whole], np.uint64)))
        else:
            found.append(np.unique(joined[end - count : end - width + 1]))
    return found


def register_values(shingles: np.ndarray) -> np.ndarray:
    """The least value in each bucket, ``VALUE_BITS`` wide, of a set that isn't empty."""
    mixed = mix(shingles ^ _STEP)
    bucket = ((mixed >> np.uint64(VALUE_BITS)) * np.uint64(REGISTERS)) >> np.uint64(64 - VALUE_BITS)
    least = np.full(REGISTERS, _VALUE_MASK + np.uint64(1))
    np.minimum.at(least, bucket.astype(np.int64), mixed & _VALUE_MASK)
    bare = np.flatnonzero(least > _VALUE_MASK)
    if len(bare):
        part = max(1, 200_000 // len(shingles))
        for i in range(0, len(bare), part):
            some = bare[i : i + part]
            least[some] = (mix(shingles[None, :] ^ _BUCKET_SEEDS[some, None]) & _VALUE_MASK).min(axis=1)
    return least


def compress(values: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of register values, in 16 bits."""
    fraction, bits = np.frexp(values.astype(np.float64))
    mantissa = np.where(values > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    zeros = (VALUE_BITS - np.where(values > 0, bits, 0)).astype(np.uint16)
    return zeros << np.uint16(MANTISSA) | mantissa


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    bands = registers.reshape(len(registers), -1, BAND_ROWS).astype(np.uint64)
    keys = (bands * _BAND_WEIGHTS).sum(axis=2, dtype=np.uint64) + np.arange(bands.shape[1], dtype=np.uint64) * _STEP
    return mix(keys).view(np.int64)


def chance_equal(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often registers of unrelated sets of n and m shingles agree: both minima in one of the cells of a level."""
    per = [np.maximum(x / REGISTERS, np.where(x < REGISTERS, x, 1)).astype(np.float64) for x in (n, m)]
    both = per[0] + per[1]
    total = np.zeros(len(both))
    for level in range(VALUE_BITS):
        high = 2.0**-level
        total += high / 2 / (1 << MANTISSA) * per[0] * per[1] / both * (np.exp(-both * high / 2) - np.exp(-both * high))
    return np.minimum(total, 0.5)


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of a batch, as bytes, of about ``BLOCK_BYTES``; nulls are empty."""
    texts: list[bytes] = []
    begin = size = 0
    for i, value in enumerate(batch.column(column).cast(pa.binary())):
        text = value.as_py() or b""
        texts.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield begin, texts
            texts, begin, size = [], i + 1, 0
    if texts:
        yield begin, texts


def sketches(df: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the whole set, registers and band keys (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in blocks(batch, 1):
                sets = shingle_sets(texts, width)
                full = [i for i, s in enumerate(sets) if len(s)]
                registers: list[bytes | None] = [None] * len(sets)
                digests: list[bytes | None] = [None] * len(sets)
                bands: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    packed = compress(np.stack([register_values(sets[i]) for i in full]))
                    keys = band_keys(packed)
                    for row, i in enumerate(full):
                        registers[i], bands[i] = packed[row].tobytes(), keys[row]
                        digests[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(registers, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest", "registers", "bands"],
                )

    schema = "doc_id bigint, n_shingles bigint, digest binary, registers binary, bands array<bigint>"
    return keyed_texts(df, key, text).mapInArrow(released(run), schema)


def least_estimate(percent: int) -> float:
    return percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5


def similar_enough(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose corrected estimate doesn't rule the threshold out, with the estimate."""
    a = rows.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a"))
    b = rows.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b"))
    # sizes alone rule many pairs out
    joined = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.stack([np.frombuffer(r, np.uint16) for r in batch.column(i).to_pylist()]) for i in (2, 3))
            by_chance = chance_equal(batch.column(4).to_numpy(), batch.column(5).to_numpy())
            estimate = ((left == right).mean(axis=1) - by_chance) / (1 - by_chance)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(estimate)], ["a", "b", "estimate"])
            yield out.filter(pa.array(estimate >= least))

    return joined.select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(released(run), "a bigint, b bigint, estimate double")


def with_sets(df: DataFrame, rows: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """``rows`` (rep, ...) with the whole shingle set of each as packed 64-bit hashes, made anew from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in blocks(batch, 1):
                sets = [s.tobytes() for s in shingle_sets(texts, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(sets, pa.binary())], ["rep", "shingles"])

    wanted = rows.select(F.col("rep").alias("doc_id")).distinct()
    sets = keyed_texts(df, key, text).join(wanted, "doc_id", "left_semi").mapInArrow(released(run), "rep bigint, shingles binary")
    # an id with several texts has several sets; its sizes tell which is which
    return sets.withColumn("n_shingles", F.expr("cast(length(shingles) / 8 as bigint)")).join(rows, ["rep", "n_shingles"])


def shared(x: np.ndarray, y: np.ndarray) -> int:
    place = np.searchsorted(y, x)
    place[place == len(y)] = 0
    return int((y[place] == x).sum())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their whole shingle sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = shared(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(released(compare), "a bigint, b bigint")


class _Joined(dict):
    """Components as they grow inside a block."""

    def top(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x


def links_of_block(strays: list[tuple], rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Links between strays and rows (rep, comp, registers, shingles), as many as join components."""
    least, joined = least_estimate(percent), _Joined()
    reps, comps = [r[0] for r in rows], [r[1] for r in rows]
    registers = np.stack([np.frombuffer(r[2], np.uint16) for r in rows])
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    for rep, comp, own_registers, own in strays:
        own, own_registers = np.frombuffer(own, np.uint64), np.frombuffer(own_registers, np.uint16)
        by_chance = chance_equal(sizes, np.full(len(sizes), len(own)))
        estimate = ((registers == own_registers).mean(axis=1) - by_chance) / (1 - by_chance)
        fit = (estimate >= least) & (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own)))
        hopeful = np.flatnonzero(fit)
        for i in hopeful[np.argsort(-estimate[hopeful], kind="stable")]:
            mine, other = joined.top(comp), joined.top(comps[i])
            if mine == other:
                continue
            both = shared(own, sets[i])
            if 100 * both >= percent * (len(own) + len(sets[i]) - both):
                joined[max(mine, other)] = min(mine, other)
                yield (rep, reps[i])


def stray_links(strays: DataFrame, members: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the strays (pivot, rep) of each pivot and its members or other strays; ``sizes``: bytes of each set."""
    sides = members.select("pivot", "rep", F.lit(False).alias("is_stray")).union(strays.select("pivot", "rep", F.lit(True)))
    everyone = stage(sides, "sides")

    def blocks_of(which: Column, name: str) -> Column:
        need = F.greatest(F.count_if(which) / BLOCK_ROWS, F.sum(F.when(which, F.col("bytes"))) / SET_BYTES)
        return F.ceil(need).cast("int").alias(name)

    counts = everyone.join(sizes, "rep").groupBy("pivot").agg(blocks_of(F.col("is_stray"), "parts"), blocks_of(F.lit(True), "cuts"))
    counts = stage(counts.where("parts > 0"), "cuts")
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    cut = F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int")
    all_parts, all_cuts = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("parts", "cuts"))
    left = everyone.where("is_stray").join(counts, "pivot").select("pivot", "rep", part.alias("part"), F.explode(all_cuts).alias("cut"), F.lit(True).alias("stray"))
    right = everyone.join(counts, "pivot").select("pivot", "rep", F.explode(all_parts).alias("part"), cut.alias("cut"), F.lit(False).alias("stray"))
    payload = sets.select("rep", "comp", "registers", "shingles")
    rows = left.union(right.select("pivot", "rep", "part", "cut", "stray")).join(payload, "rep")
    placed = rows.repartition("pivot", "part", "cut").sortWithinPartitions("pivot", "part", "cut", "stray", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sides = None, ([], [])

        def flush() -> pa.RecordBatch:
            found = list(links_of_block(sides[1], sides[0], percent)) if sides[0] and sides[1] else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if row[:3] != place:
                    yield flush()
                    place, sides = row[:3], ([], [])
                sides[row[3]].append(row[4:])
        yield flush()

    columns = placed.select("pivot", "part", "cut", "stray", "rep", "comp", "registers", "shingles")
    return columns.mapInArrow(released(run), "a bigint, b bigint")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id) and kept, for every row of ``df``."""
    drawn = stage(sketches(df, width, key, text), "sketches")
    classes = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times"))
    # rows of a large class go to several tasks, each with its own copy of the class's row; rows without a set need none
    classes = stage(classes, "digests")
    most = max(1, (classes.agg(F.sum("times")).first()[0] or 0) // SHARES)
    salts = F.ceil(F.col("times") / most).cast("int")
    large = classes.where(F.col("times") > most).select("digest", salts.alias("salts"))
    salted = classes.select("digest", "rep", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    worded = drawn.where("digest IS NOT NULL").join(F.broadcast(large), "digest", "left")
    worded = worded.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    classed = worded.join(salted, ["digest", "salt"], "left").unionByName(drawn.where("digest IS NULL"), allowMissingColumns=True)
    rows = stage(
        classed.select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"),
            *(F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("registers", "bands")),
        ),
        "classes",
    )
    reps = rows.where("doc_id = rep").select("rep", "n_shingles", "registers", "bands")
    # a class written by several rows of its first id comes once
    reps = reps.dropDuplicates(["rep", "registers"])
    banded = reps.select("rep", F.explode("bands").alias("band"))
    crowds = banded.groupBy("band").agg(F.count("*").alias("crowd")).where("crowd > 1")
    met = stage(banded.join(crowds, "band"), "buckets")
    sets = stage(with_sets(df, reps.select("rep", "n_shingles", "registers").join(met.select("rep").distinct(), "rep"), width, key, text), "sets")

    meetings = met.join(met.groupBy("rep").agg(F.sum("crowd").alias("meetings")), "rep")
    hubs = meetings.groupBy("band").agg(F.max(F.struct("meetings", (-F.col("rep")).alias("first"))).alias("hub"))
    hubs = hubs.select("band", (-F.col("hub.first")).alias("hub"))
    to_hub = met.join(hubs, "band").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    near = similar_enough(to_hub, reps, percent)
    best = near.groupBy("b").agg(F.max(F.struct("estimate", (-F.col("a")).alias("first"))).alias("best"))
    best = best.select((-F.col("best.first")).alias("a"), "b")
    # an id of several classes belongs to all of them
    of_ids = rows.where("rep IS NOT NULL").select("doc_id", "rep").distinct()
    firsts = of_ids.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last")
    several = stage(of_ids.join(firsts, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")), "several")
    joined = components(stage(confirmed(best, sets, percent).union(several), "links"))

    own = F.coalesce("component", "rep").alias("comp")
    labelled = stage(met.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", own), "labels")
    shares = labelled.groupBy("band", "comp").agg(F.count("*").alias("share")).groupBy("band")
    pivots = shares.agg(F.max(F.struct("share", (-F.col("comp")).alias("first"))).alias("top"), F.count("*").alias("comps"))
    pivots = pivots.where("comps > 1").select("band", (-F.col("top.first")).alias("pivot"))
    strays = stage(labelled.join(pivots, "band").where("comp <> pivot").select("pivot", "rep").distinct(), "strays")
    members = labelled.select(F.col("comp").alias("pivot"), "rep").distinct().join(strays.select("pivot").distinct(), "pivot")
    known = sets.join(labelled.select("rep", "comp").distinct(), "rep")
    sizes = sets.select("rep", (F.col("n_shingles") * 8).alias("bytes"))
    more = stray_links(strays, members, known, sizes, percent)
    final = components(joined.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))

    label = F.coalesce("component", "rep", "doc_id")
    return (
        rows.join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", label.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, less all but one document of each group (its smallest id stays).

    Rows without words or without an id stay.  Of several rows with words under one id, one stays.
    """
    found = stage(near_duplicates(df, width, percent, key, text), "duplicates")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(f"`{key}`").cast("bigint").alias("_key"))
    rows = rows.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    repeated = found.where("n_shingles > 0 AND kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    repeated = repeated.select(F.col("doc_id").alias("_again"))
    if repeated.limit(1).count():
        again = F.col("_key") == F.col("_again")
        content = F.coalesce(F.col("_row")[text], F.lit(""))
        worded = content.rlike(WORD_PATTERN)
        single = rows.join(repeated, again & worded, "left_anti")
        first = rows.where(worded).join(repeated, again, "left_semi").groupBy("_key").agg(F.min_by("_row", F.struct(F.xxhash64(content), content)).alias("_row"))
        rows = single.select("_row").union(first.select("_row"))
    return rows.select("_row.*")

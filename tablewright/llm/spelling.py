"""Grouping of spelling variants: blocked Gram matrices of letter counts find words one edit apart.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are
lower-cased; those of at least ``shortest`` code points that occur at least
``least`` times take part.  Two words are near if one inserted, deleted or
replaced code point makes one the other.

Blocks.  Words of length m meet words of length m and m + 1.  An edit leaves the
first m // 2 code points alone or the last m - m // 2, so a block holds the
words of both lengths that share such a beginning or such an ending.  A pair is
compared in the block of its beginning, in the one of its ending only if the
beginnings differ.  A block of many words is cut into parts of about ``TILE``,
dealt out by hash, and each two parts meet in a task of their own.

Gram matrices.  Of the letter counts X and Y of two lots of words, NumPy gives
all squared distances at once: |x|^2 + |y|^2 - 2 X Y'.  A replaced letter
makes 2, an inserted one 1, a changed order 0; pairs above 2 go, the others are
verified letter by letter.  Small blocks share a product.  What leaves a task
is one row for each word with any near word, not a row for each pair.

Null and empty texts hold no words; very long texts and words are taken whole.
A null id counts as empty.  Rows that repeat each other count again.  Of words
of equal counts the smallest in code-point order is the form.  An empty table
gives an empty result.  Columns besides the two read cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import keyed_texts
from tablewright.operators.staging import stage

RUN = re.compile("[a-zÀ-ÿ]+")
SHORTEST = 5
LEAST = 3
RARE = 97
TILE = 1024
#: words whose counts a task holds before it hands them on
HELD = 100_000
#: words compared by one product, pairs verified at once, and code points above which words are verified one by one
LOT, PAIRS, LONG = 512, 100_000, 64
LETTERS = 96  # a-z and U+00C0 to U+00FF, each a column

WORDS = "word string, n bigint"
FOUND = "word string, n_near bigint, best_n bigint, best string"


def misspelled(run: str, doc: int | None, rare: int) -> str:
    """The run, less one code point where its draw says so."""
    drawn = zlib.crc32(run.encode(), doc)
    if drawn % rare:
        return run
    at = drawn % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, rare: int = RARE) -> DataFrame:
    """(word, n) of the words that take part; one run in ``rare`` of a document loses a code point first."""

    def handed_on(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if not value.is_valid:
                    continue
                # of bytes, only A-Z are lower-cased
                runs = Counter(RUN.findall(value.as_py().lower().decode("utf-8", "replace")))
                doc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found, n in runs.items():
                    if len(found) >= shortest:
                        word = misspelled(found, doc, rare)
                        if len(word) >= shortest:
                            counts[word] += n
                if len(counts) >= HELD:
                    yield handed_on(counts)
                    counts = Counter()
        yield handed_on(counts)

    parts = keyed_texts(df, key, text).mapInArrow(run, WORDS)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def in_blocks(words: DataFrame, tile: int) -> DataFrame:
    """Each word in the blocks of its halves: (side, m, part, i, j, own, word, n), ``i`` <= ``j`` the parts that meet."""
    size = F.length("word")

    def half(m: Column, side: str) -> Column:
        first = F.floor(m / 2).cast("int")
        share = F.substring("word", F.lit(1), first) if side == "begin" else F.substring(F.col("word"), size - (m - first) + 1, m - first)
        return F.struct(F.lit(side).alias("side"), m.cast("int").alias("m"), share.alias("part"))

    halves = F.array(*(half(m, side) for m in (size, size - 1) for side in ("begin", "end")))
    placed = words.select("word", "n", F.inline(halves))
    block = ["side", "m", "part"]
    sizes = placed.groupBy(*block).agg(F.count("*").alias("size"), F.count_if(size == F.col("m")).alias("shorter"))
    # without a second word, or without one of the shorter length, nothing can be near
    sizes = sizes.where("size > 1 AND shorter > 0").select(*block, F.ceil(F.col("size") / tile).cast("int").alias("parts"))
    placed = placed.join(sizes, block).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select(*block, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n")


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).astype(np.int64)
    letters = np.where(codes < 0xC0, codes - ord("a"), codes - 0xC0 + 32)
    flat = np.bincount(np.repeat(np.arange(len(words)), sizes) * LETTERS + letters, minlength=len(words) * LETTERS)
    # whole numbers that single precision holds exactly, but for very long words
    return flat.reshape(-1, LETTERS).astype(np.float32 if sizes.max() < 2_000 else np.float64)


def padded(words: list[str], width: int, right: bool) -> np.ndarray:
    lined = [w.rjust(width) if right else w.ljust(width) for w in words]
    return np.frombuffer("".join(lined).encode("utf-16-le"), np.uint16).reshape(len(words), width)


def one_edit(x: str, y: str) -> bool:
    """Whether ``y``, as long as ``x`` or one longer, is one edit away."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    at = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return x[at:] == y[at + 1 :]


def verified(words: list[str], sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (places a, b; b as long or one longer) are one edit apart."""
    good = np.zeros(len(a), bool)
    long = np.flatnonzero(sizes[b] > LONG)
    for k in long.tolist():
        good[k] = one_edit(words[a[k]], words[b[k]])
    short = np.flatnonzero(sizes[b] <= LONG)
    if not len(short):
        return good
    kept = [w if len(w) <= LONG else "" for w in words]
    width = max(map(len, kept))
    left, right = padded(kept, width, False), padded(kept, width, True)
    for begin in range(0, len(short), PAIRS):
        part = short[begin : begin + PAIRS]
        x, y = a[part], b[part]
        differ = left[x] != left[y]
        same_size = sizes[x] == sizes[y]
        # equal letters from the left and from the right, the shorter word's padding not among them
        from_left = np.where(differ.any(axis=1), differ.argmax(axis=1), sizes[x])
        apart = (right[x] != right[y])[:, ::-1]
        from_right = np.where(apart.any(axis=1), apart.argmax(axis=1), sizes[x])
        good[part] = np.where(same_size, differ.sum(axis=1) == 1, np.minimum(from_left, sizes[x]) + np.minimum(from_right, sizes[x]) >= sizes[x])
    return good


class Lot:
    """Tiles whose words are compared by common products."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.tile: list[int] = []

    def near_words(self) -> Iterator[tuple[str, int, int, str]]:
        """(word, near words, count of the most frequent, that word) inside the tiles."""
        words = [r[6] for r in self.rows]
        counts = np.array([r[7] for r in self.rows], np.int64)
        sizes, m = np.array([len(w) for w in words]), np.array([r[1] for r in self.rows])
        tile, own = np.array(self.tile), np.array([r[5] for r in self.rows])
        mixed = np.array([r[3] != r[4] for r in self.rows])
        ending = np.array([r[0] == "end" for r in self.rows])
        vectors = letter_counts(words)
        squares = (vectors * vectors).sum(axis=1)
        order = np.flatnonzero(sizes == m)  # the shorter length meets both
        pairs = []
        for begin in range(0, len(order), LOT):
            some = order[begin : begin + LOT]
            distance = squares[some, None] + squares[None, :] - 2 * (vectors[some] @ vectors.T)
            x, b = np.nonzero((distance <= 2) & (tile[some, None] == tile[None, :]))
            pairs.append((some[x], b))
        a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
        keep = ((sizes[a] < sizes[b]) | (a < b)) & (~mixed[a] | (own[a] != own[b]))
        a, b = a[keep], b[keep]
        good = verified(words, sizes, a, b) if len(a) else np.zeros(0, bool)
        a, b = a[good], b[good]
        if ending.any():  # pairs that share their beginning were compared there
            again = np.array([ending[i] and words[i][: m[i] // 2] == words[j][: m[i] // 2] for i, j in zip(a.tolist(), b.tolist())], bool)
            a, b = a[~again], b[~again]
        if not len(a):
            return
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        # rows of a tile are in code-point order, so the first of equal counts is the smallest word
        ranked = np.lexsort((target, -counts[target], source))
        source, target = source[ranked], target[ranked]
        first = np.flatnonzero(np.diff(source, prepend=-1))
        n_near = np.diff(np.append(first, len(source)))
        for place, near, n in zip(source[first].tolist(), target[first].tolist(), n_near.tolist()):
            yield words[place], n, int(counts[near]), words[near]


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best): how many words of (word, n) are near each, and the most frequent of them."""
    key = ["side", "m", "part", "i", "j"]
    rows = in_blocks(words, tile).repartition(*key).sortWithinPartitions(*key, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(lot: Lot) -> pa.RecordBatch:
            found = list(lot.near_words()) if lot.rows else []
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["word", "n_near", "best_n", "best"])

        lot, place, number = Lot(), None, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if row[:5] != place:
                    place, number = row[:5], number + 1
                    if len(lot.rows) >= LOT:
                        yield results(lot)
                        lot = Lot()
                lot.rows.append(row)
                lot.tile.append(number)
        yield results(lot)

    found = rows.mapInArrow(run, FOUND)
    least_first = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least_first.alias("top"))
    return best.select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``: where following forms ends.  Steps double, so ten of them follow a thousand forms."""
    steps = stage(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stage(moved, "roots")
        if not moved.where("moved").limit(1).count():
            break
        steps = moved.drop("moved")
    return forms.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", factor: int = 2, tile: int = TILE, **options) -> DataFrame:
    """Per word: word, form (near word of most occurrences, at least ``factor`` times its own), root, n, n_near, form_n."""
    words = stage(word_counts(df, key, text, **options), "words")
    joined = words.join(near_words(words, tile), "word", "left")
    leads = F.col("best_n") >= F.col("n") * factor
    forms = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(leads, F.col("best")).alias("form"),
        F.when(leads, F.col("best_n")).alias("form_n"),
    )
    return rooted(stage(forms, "variants")).select("word", "form", "root", "n", "n_near", "form_n")

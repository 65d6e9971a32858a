"""Toxicity of texts: a linear softmax over averaged subword embeddings, both trained here, in numpy.

A word is the bag of its character n-grams (and itself between marks), so a
misspelling nobody has seen shares most of its vectors with the word it is
made from.  The unit that is averaged and classified is a window of a few
words, because one insult in ten thousand words is lost in a mean over the
text; a text scores as its most toxic window.  Windows carry no labels of
their own: training alternates between choosing each text's highest windows
and fitting embeddings and softmax to them.

Training sees a bounded sample of labelled texts (``Sample``); scoring sees
every word of every text.  Nulls and empty texts get the score of an empty
bag, which is the bias alone.  Repeated rows score alike.  Rows with a label
that is null, and texts that a label names but ``docs`` lacks, teach nothing;
without examples of both classes every text scores the share of label 1 (0
without labels).
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import keyed_texts, released

BUCKETS = 1 << 17
DIMENSIONS = 16
GRAMS = (3, 4, 5)
WINDOW = 1
WORDS_KEPT = 150_000
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
TRIM = re.compile(r"^[\W_]+|[\W_]+$")
#: odd multipliers that spread code points over 64 bits
SPREAD = np.random.default_rng(20).integers(1 << 62, 1 << 63, 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: characters of text whose new words are hashed together
BLOCK_CHARS = 2_000_000


@dataclasses.dataclass(frozen=True)
class Sample:
    """The bound of what training reads: so many texts of either class, the first in order of a hash of their id, none longer than ``chars``."""

    toxic: int = 1_000
    clean: int = 2_000
    chars: int = 20_000


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every word and of the word itself, one word after the other, and where each begins; no word has none."""
    marked = [f"<{TRIM.sub('', word) or word}>" for word in map(str.lower, words)]
    sizes = np.array([len(w) for w in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(marked)), sizes)
    within = np.arange(len(points)) - starts[owner]
    powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, SPREAD[0], np.uint64))
    found, of = [np.add.reduceat(points * powers[within], starts) if len(points) else points], [np.arange(len(marked))]
    for n in GRAMS:
        at = np.flatnonzero(within + n <= sizes[owner])
        mixed = np.full(len(at), n, np.uint64)
        for i in range(n):
            mixed += points[at + i] * SPREAD[i + 1]
        found.append(mixed)
        of.append(owner[at])
    mixed = np.concatenate(found)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * SPREAD[-1]
    of_word = np.concatenate(of)
    order = np.argsort(of_word, kind="stable")
    counts = np.bincount(of_word, minlength=len(marked))
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)[order], np.cumsum(counts) - counts


@dataclasses.dataclass
class Model:
    embedding: np.ndarray
    softmax: np.ndarray  # DIMENSIONS + 1 rows (the last is the bias), a column for each class
    prior: float | None = None  # the constant score of a model without examples

    def gram_scores(self) -> np.ndarray:
        """What each n-gram adds to the log odds; the two linear layers folded into one."""
        return (self.embedding @ (self.softmax[:-1, 1] - self.softmax[:-1, 0])).astype(np.float64)

    @property
    def bias(self) -> float:
        return float(self.softmax[-1, 1] - self.softmax[-1, 0])


class Bags:
    """Labelled texts as word numbers, and the n-grams of every distinct word."""

    def __init__(self, texts: list[str]):
        numbers: dict[str, int] = {}
        words, lengths = array("i"), []
        for text in texts:
            found = [numbers.setdefault(w, len(numbers)) for w in SPLIT.findall(text)]
            words.extend(found + found[-1:] * (WINDOW - len(found)))
            lengths.append(max(WINDOW, len(found)) if found else 0)
        self.texts = len(texts)
        self.words = np.frombuffer(words, np.int32) if words else np.zeros(0, np.int32)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        # a part of the words at a time: the hashes before they become buckets are wide
        known = list(numbers)
        parts = [grams_of(known[i : i + 20_000]) for i in range(0, len(known), 20_000)]
        counts = [np.diff(np.append(starts, len(grams))) for grams, starts in parts]
        self.grams = np.concatenate([grams.astype(np.int32) for grams, _ in parts]) if parts else np.zeros(0, np.int32)
        self.gram_ends = np.cumsum(np.concatenate(counts)) if counts else np.zeros(0, np.int64)
        self.gram_starts = np.concatenate([[0], self.gram_ends[:-1]]).astype(np.int64) if counts else self.gram_ends

    def word_means(self, gram_values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(gram_values[self.grams], self.gram_starts) / (self.gram_ends - self.gram_starts)

    def top_windows(self, word_values: np.ndarray, per_text: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, first word) of the highest windows of each text that has words, the highest first."""
        sums = np.concatenate([[0], np.cumsum(word_values[self.words])])
        texts, places = [], []
        for text in np.flatnonzero(self.lengths):
            a, b = self.starts[text], self.starts[text + 1]
            means = sums[a + WINDOW : b + 1] - sums[a : b - WINDOW + 1]
            top = np.argpartition(-means, min(per_text, len(means)) - 1)[:per_text]
            texts.extend([text] * len(top))
            places.extend(a + top)
        return np.array(texts, np.int64), np.array(places, np.int64)

    def window_grams(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the windows at ``places``: window number, bucket and weight of every n-gram in them."""
        words = self.words[places[:, None] + np.arange(WINDOW)].ravel()
        counts = (self.gram_ends - self.gram_starts)[words]
        owner = np.repeat(np.arange(len(words)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        return owner // WINDOW, self.grams[self.gram_starts[words][owner] + within], 1.0 / (counts[owner] * WINDOW)


def train(texts: list[str], labels: list[int], rounds: int = 4, epochs: int = 3, rate: float = 0.08, keep: float = 0.6, seed: int = 7) -> Model:
    """Embeddings and softmax fitted jointly by Adagrad on the highest windows of each text, chosen anew each round."""
    y_all = np.array(labels, np.int64)
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    softmax = np.zeros((DIMENSIONS + 1, 2))
    share = float(y_all.mean()) if len(y_all) else 0.0
    bags = Bags(texts)
    if not 0 < share < 1 or not len(bags.words):
        return Model(embedding.astype(np.float32), softmax, prior=share)
    # the first choice of windows: how much more often an n-gram occurs in toxic texts than in others
    text_of = np.repeat(np.arange(bags.texts), bags.lengths)
    pairs = np.unique(text_of * (len(bags.gram_ends) + 1) + bags.words.astype(np.int64))
    word_texts = np.stack([np.bincount(pairs[y_all[pairs // (len(bags.gram_ends) + 1)] == c] % (len(bags.gram_ends) + 1), minlength=len(bags.gram_ends)) for c in (0, 1)])
    seen = [np.bincount(bags.grams, np.repeat(word_texts[c], bags.gram_ends - bags.gram_starts), BUCKETS) for c in (0, 1)]
    counts = [max(1, int((y_all == c).sum())) for c in (0, 1)]
    values = bags.word_means(np.log((seen[1] / counts[1] + 2e-3) / (seen[0] / counts[0] + 2e-3)))
    past_e, past_s = np.full((BUCKETS, 1), 1e-8), np.full(softmax.shape, 1e-8)
    for step in range(rounds):
        texts_of, places = bags.top_windows(values, 1)
        more, spots = bags.top_windows(values, 4)
        clean = y_all[more] == 0  # every window of a clean text is clean; of a toxic one only the highest is taken for toxic
        filler = rng.integers(0, len(bags.words) - WINDOW + 1, len(places))
        inside = (text_of[filler] == text_of[filler + WINDOW - 1]) & (y_all[text_of[filler]] == 0)
        texts_of = np.concatenate([texts_of, more[clean], text_of[filler[inside]]])
        places = np.concatenate([places, spots[clean], filler[inside]])
        y = y_all[texts_of]
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(places)), max(1, len(places) // 512)):
                row, gram, weight = bags.window_grams(places[part])
                kept = rng.random(len(row)) < keep  # so that part of a word's n-grams must do, as in a misspelling
                row, gram, weight = row[kept], gram[kept], weight[kept] / keep
                used, index = np.unique(gram, return_inverse=True)
                vectors = embedding[used]
                means = np.zeros((len(part), DIMENSIONS))
                for d in range(DIMENSIONS):
                    means[:, d] = np.bincount(row, vectors[index, d] * weight, len(part))
                inputs = np.concatenate([means, np.ones((len(part), 1))], axis=1)
                logits = inputs @ softmax
                chance = np.exp(logits - logits.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                error = chance
                error[np.arange(len(part)), y[part]] -= 1
                to_mean = error @ softmax[:-1].T
                grad_s = inputs.T @ error / len(part) + 1e-4 * softmax
                grad_e = np.stack([np.bincount(index, to_mean[row, d] * weight, len(used)) for d in range(DIMENSIONS)], axis=1)
                past_s += grad_s**2
                past_e[used] += (grad_e**2).mean(axis=1, keepdims=True)
                softmax -= rate * grad_s / np.sqrt(past_s)
                embedding[used] -= rate * grad_e / np.sqrt(past_e[used])
        values = bags.word_means(embedding @ (softmax[:-1, 1] - softmax[:-1, 0]))
    return Model(embedding.astype(np.float32), softmax)


class Scorer:
    """Scores of whole texts; remembers what words add from batch to batch."""

    def __init__(self, gram_scores: np.ndarray, bias: float, prior: float | None):
        self.gram_scores, self.bias, self.prior = gram_scores, bias, prior
        self.known: dict[str, float] = {}

    def score(self, texts: list[str | None]) -> Iterator[float]:
        block: list[list[str]] = []
        chars = 0
        for text in texts:
            block.append([] if self.prior is not None else SPLIT.findall(text or ""))
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield from self._score_block(block)
                block, chars = [], 0
        yield from self._score_block(block)

    def _score_block(self, block: list[list[str]]) -> Iterator[float]:
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        known = self.known
        new = list(set().union(*block).difference(known))
        if new:
            grams, starts = grams_of(new)
            sums = np.add.reduceat(self.gram_scores[grams], starts)
            known.update(zip(new, (sums / np.diff(np.append(starts, len(grams)))).tolist()))
        for words in block:
            if self.prior is not None:
                yield self.prior
                continue
            odds = self.bias
            if words:
                words = words + words[-1:] * (WINDOW - len(words))
                values = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                means = values[: len(values) - WINDOW + 1].copy()
                for shift in range(1, WINDOW):
                    means += values[shift : len(values) - WINDOW + 1 + shift]
                odds += float(means.max()) / WINDOW
            yield 1.0 / (1.0 + float(np.exp(-np.clip(odds, -500, 500))))


def held_out(key: Column) -> Column:
    """A fifth of all ids, by crc32 of the id as text; its labels are never learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on a bounded sample of the labelled rows that are not held out."""
    rows = labels.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    chosen = None
    for value, most in ((1, sample.toxic), (0, sample.clean)):
        part = rows.where(F.col("label") == value).orderBy("place", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = keyed_texts(docs, key, text).where(F.length("text") <= sample.chars)
    # the chosen ids are bounded by the sample, so their broadcast is too
    found = texts.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id").select("doc_id", "text", "label").toArrow()
    order = np.lexsort((np.array([zlib.crc32(t.encode()) for t in found["text"].to_pylist()], np.int64), found["doc_id"].to_numpy()))
    texts_of, labels_of = found["text"].to_pylist(), found["label"].to_pylist()
    return train([texts_of[i] for i in order], [labels_of[i] for i in order])


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every whole text."""
    parts = (model.gram_scores(), model.bias, model.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*parts)
        for batch in batches:
            found = list(scorer.score(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return keyed_texts(docs, key, text).mapInArrow(released(run), "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below the threshold."""
    parts, place = (model.gram_scores(), model.bias, model.prior), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*parts)
        for batch in batches:
            yield batch.filter(pa.array([x < threshold for x in scorer.score(batch.column(place).to_pylist())], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)

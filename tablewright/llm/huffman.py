"""Token ids in compact files: canonical length-limited Huffman codes, blocks that decode independently.

Writing.  Ids are counted over the whole corpus (per task first, then summed;
one row for each id of the vocabulary reaches the driver).  The package-merge
method gives every id a code of at most ``LIMIT`` bits.  Documents are put in
ascending order by a range shuffle; each partition is a shard, a shard a run of
chunks, a chunk some whole documents in one stream of bits.  Every
``BLOCK``-th id of a chunk has a checkpoint, the bit at which it begins.

Files.  Two Parquet tables under one folder: ``codes`` (id, length), from which
the canonical codes follow, and ``chunks`` (shard, chunk, before, doc_ids,
doc_tokens, checkpoints, payload).  Parquet keeps the files readable on any
store Spark reads and leaves commits and retries to Spark.

Reading.  All blocks of a chunk decode side by side: each step looks up the
next ``LIMIT`` bits of every block in one table of (id, length).

Nulls count as empty texts; an empty text is the end id alone.  Documents
without an id come first.  Rows that repeat an id follow each other in order
of their token ids.  An empty table writes no chunk and reads as no rows.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import keyed_texts, tokenizer_file
from tablewright.operators.staging import staging_root

LIMIT = 20
BLOCK = 2_048
CHUNK_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 23
#: fixed value: ASCII marks but the apostrophe, which may begin a token with letters
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: words whose ids a Python worker remembers; refilled, never cut off
WORDS_KEPT = 700_000
#: characters of text whose new words go to the tokenizer together
BLOCK_CHARS = 4_000_000


class _Words:
    """Ids of the stretches between blanks, packed; asks the tokenizer for those it lacks.

    The pre-tokenizer drops white space and no token spans it, so a text's ids
    are those of its stretches.  A stretch of letters is one word to the
    tokenizer, and its last token carries the mark of a word's end; so new ones
    go to the tokenizer many at a time and are told apart by those marks.
    """

    def __init__(self, path: str, code: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer, self.code = Tokenizer.from_file(path), code
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        block: list[list[str]] = []
        chars = 0
        for text in texts:
            block.append(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield from self._encode_block(block)
                block, chars = [], 0
        yield from self._encode_block(block)

    def _encode_block(self, block: list[list[str]]) -> Iterator[bytes]:
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        known = self.known
        new = set().union(*block).difference(known)
        # marks after letters are cut off as one run, and below U+0100 every library agrees on lower case
        plain = {word: self._letters(word) for word in new}
        letters = {part for part in plain.values() if part and part not in known}
        if letters:
            self._learn(list(letters))
        for word, part in plain.items():
            if not part:
                known[word] = self._one(word)
            elif part is not word:
                mark = word[len(part) :]
                known[word] = known[part] + (self._one(mark) if mark else b"")
        for words in block:
            yield b"".join(map(known.__getitem__, words))

    @staticmethod
    def _letters(word: str) -> str:
        part = word.rstrip(MARKS)
        return part.lower() if part.isalpha() and max(part) < "\u0100" else ""

    def _one(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            if len(word) <= 4:  # marks recur behind other words
                self.known[word] = found
        return found

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            self.known.update((word, self._one(word)) for word in words)
            return
        packed, width = array(self.code, ids.tolist()).tobytes(), array(self.code).itemsize
        stops = (ends * width).tolist()
        self.known.update(zip(words, map(packed.__getitem__, map(slice, [0, *stops], stops))))


@functools.lru_cache(maxsize=2)
def _words(path: str, code: str) -> _Words:
    return _Words(path, code)


def vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(tokenizer)).get_vocab_size(with_added_tokens=True)


def tokenized(df: DataFrame, tokenizer: str, end_id: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (packed, two bytes each where the vocabulary allows) with ``end_id`` last."""
    code = "H" if size <= 1 << 16 else "I"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(tokenizer_file(tokenizer), code), array(code, [end_id]).tobytes()
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            ids = [packed + end for packed in words.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return keyed_texts(df, key, text).mapInArrow(run, "doc_id bigint, ids binary")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    merged, leaf_flags = leaves, []
    for level in range(limit):
        if level:
            packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([leaves, packages])
            place = np.argsort(both, kind="stable")
            merged, flags = both[place], place < len(leaves)
        else:
            flags = np.ones(len(leaves), bool)
        leaf_flags.append(flags)
    take = 2 * len(leaves) - 2
    depth = np.zeros(len(leaves) + 1, np.int64)
    for flags in reversed(leaf_flags):
        n_leaves = int(flags[:take].sum())
        depth[0] += 1
        depth[n_leaves] -= 1
        take = 2 * (take - n_leaves)
    lengths[order] = np.cumsum(depth[:-1])
    return lengths


class Codes:
    """Canonical codes: shorter first, then by id; the table that reads them follows from the lengths alone."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        self.width = int(lengths.max(initial=1))
        spans = np.int64(1) << (self.width - lengths[order].astype(np.int64))
        begins = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (begins >> (self.width - lengths[order].astype(np.int64))).astype(np.uint64)
        table = np.repeat(order.astype(np.int64) << 6 | lengths[order], spans)
        self.table = np.concatenate([table, np.zeros((1 << self.width) - len(table), np.int64)])

    def write(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids``, and the bit at which each ``BLOCK``-th of them begins."""
        sizes = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        word = begins >> 5
        shifted = self.codes[ids] << (64 - (begins & 31) - sizes).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.bitwise_or.reduceat(shifted, first)
        bits = np.zeros((int(ends[-1]) >> 5) + 3, np.uint32)
        at = word[first]
        bits[at] |= (sums >> np.uint64(32)).astype(np.uint32)
        bits[at + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return bits.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], begins[::BLOCK]

    def read(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a chunk; its blocks are decoded side by side."""
        if not n:
            return np.zeros(0, np.int64)
        padded = np.frombuffer(payload + bytes(16 - len(payload) % 4), ">u4").astype(np.uint64)
        windows = padded[:-1] << np.uint64(32) | padded[1:]
        out = np.zeros((BLOCK, len(checkpoints)), np.int32)
        at = checkpoints.astype(np.int64)
        last = n - (len(checkpoints) - 1) * BLOCK  # ids of the last block
        shift, mask = 64 - self.width, np.uint64((1 << self.width) - 1)
        for step in range(min(BLOCK, n)):
            if step == last:
                at = at[:-1]
                if not len(at):
                    break
            found = self.table[(windows[at >> 5] >> (shift - (at & 31)).astype(np.uint64)) & mask]
            out[step, : len(at)] = found >> 6
            at = at + (found & 63)
        return out.T.reshape(-1)[:n]


def write_ids(
    df: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text and write the files under ``folder``, documents in ascending order of their ids."""
    spark = df.sparkSession
    size = max(vocabulary_size(tokenizer), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    tokenized(df, tokenizer, end_id, size, key, text).write.parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    # at most one row for each id of the vocabulary
    found = ids.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    lengths = code_lengths(counts)
    coded = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(coded, "id bigint, length int").coalesce(1).write.parquet(f"{folder}/codes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, shard = Codes(lengths), TaskContext.get().partitionId()
        chunk = before = held = 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            stream = np.concatenate(parts)
            payload, checkpoints = codes.write(stream)
            row = [[shard], [chunk], [before], [docs], [[len(p) for p in parts]], [checkpoints], [payload]]
            return pa.RecordBatch.from_pylist([dict(zip(CHUNKS.names, (x[0] for x in row)))], CHUNKS)

        for batch in batches:
            for doc, packed in zip(batch.column(0), batch.column(1)):
                docs.append(doc.as_py())
                parts.append(np.frombuffer(packed.as_py(), kind))
                held += len(parts[-1])
                if held >= CHUNK_TOKENS:
                    yield flush()
                    chunk, before, held, docs, parts = chunk + 1, before + held, 0, [], []
        if docs:
            yield flush()

    shards = max(1, -(-int(counts.sum()) // SHARD_TOKENS))
    # the hash lets rows of one id be told apart, so that ranges may part them
    placed = ids.withColumn("tie", F.xxhash64("ids")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    placed.select("doc_id", "ids").mapInArrow(write, CHUNK_COLUMNS).write.parquet(f"{folder}/chunks")


CHUNK_COLUMNS = "shard bigint, chunk bigint, before bigint, doc_ids array<bigint>, doc_tokens array<bigint>, checkpoints array<bigint>, payload binary"
CHUNKS = pa.schema(
    [
        ("shard", pa.int64()),
        ("chunk", pa.int64()),
        ("before", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("checkpoints", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def read_ids(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids of every document, read from the files alone.

    Ids come packed as little-endian unsigned 32-bit integers (``ids``), or,
    with ``digest_only``, as the crc32 of those bytes (``ids_crc32``).
    """
    table = spark.read.parquet(f"{folder}/codes").toArrow()  # one row for each id of the vocabulary
    lengths = np.zeros(int(max(table["id"].to_pylist(), default=0)) + 1, np.uint8)
    lengths[table["id"].to_numpy()] = table["length"].to_numpy()
    chunks = spark.read.parquet(f"{folder}/chunks")
    in_chunk = F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    # one row for each shard, and a shard is millions of ids
    sizes = chunks.groupBy("shard").agg(F.sum(in_chunk).alias("n")).orderBy("shard").collect()
    bases, total = {}, 0
    for row in sizes:
        bases[row["shard"]], total = total, total + row["n"]
    name, kind = ("ids_crc32", pa.int64()) if digest_only else ("ids", pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                shard, before, docs, sizes, checkpoints, payload = (batch.column(i)[row] for i in range(6))
                tokens = np.array(sizes.as_py(), np.int64)
                ids = codes.read(payload.as_py(), np.array(checkpoints.as_py(), np.int64), int(tokens.sum())).astype("<u4")
                ends = np.cumsum(tokens)
                starts = bases[shard.as_py()] + before.as_py() + ends - tokens
                packed = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), tokens.tolist())]
                values = [zlib.crc32(p) for p in packed] if digest_only else packed
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(starts), pa.array(tokens), pa.array(values, kind)], ["doc_id", "start", "n_tokens", name]
                )

    columns = chunks.select("shard", "before", "doc_ids", "doc_tokens", "checkpoints", "payload")
    return columns.mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint, {name} {'bigint' if digest_only else 'binary'}")


def new_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/tablewright/ids-{uuid.uuid4().hex}"

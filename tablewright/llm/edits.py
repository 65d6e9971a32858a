"""Token counts that follow edits: a segment tree of pre-token runs per document, of which edits touch a few leaves.

Tree.  A document is cut into pre-tokens, ``LEAF`` of them make a leaf; a leaf
knows its characters and its tokens, an inner node the sums of its two
children.  Offsets are found by descending along the sums.

Edits.  An edit replaces characters [start, end) by a text; edits of a document
apply one after the other, each to the text the ones before have left.  Pre-
tokens depend on what is left of them only through where they begin, and on two
characters to their right.  So cutting starts anew at a leaf that begins at
least ``CONTEXT`` characters before the edit, and stops as soon as a pre-token
ends behind the edit where an old leaf began: from there on nothing changes.
Only the pre-tokens in between are encoded; their leaves and the sums above
them are replaced.

Strings of special tokens in a text count as ordinary text.  Nulls count as
empty texts, with no tokens; edits that lie beyond a text's end are moved to
it, and null edits or replacements count as none and empty.  Repeated rows are
edited each on its own.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.bpe import PRETOKEN, PRETOKEN_LATIN, Vocabulary, vocabulary
from tablewright.llm.common import tokenizer_file

LEAF = 16
CONTEXT = 4
#: characters of text whose words are encoded together
BLOCK_CHARS = 4_000_000
EDITS = "array<struct<start:bigint,end:bigint,replacement:string>>"
#: words whose counts a Python worker remembers; refilled, never cut off
WORDS_KEPT = 200_000


class Counter:
    """Tokens of pre-tokens, by the walk over their trie; remembers the words it has met."""

    def __init__(self, own: Vocabulary):
        self.own = own
        self.known: dict[str, int] = {}

    def count(self, pieces: list[list[str]]) -> list[np.ndarray]:
        """The token counts of each list's pieces."""
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        new = set().union(*pieces).difference(known)
        if new:
            for word, ids in self.own.encode_words({piece.encode() for piece in new}):
                known[word.decode()] = len(ids)
        return [np.fromiter(map(known.__getitem__, part), np.int64, len(part)) for part in pieces]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


class CountTree:
    """Characters and tokens of the leaves of one text, and their sums in a binary heap (node i over 2i and 2i+1)."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = len(chars)
        self.width = 1 << max(0, self.leaves - 1).bit_length()
        self.chars, self.tokens = (np.zeros(2 * self.width, np.int64) for _ in range(2))
        self.chars[self.width : self.width + self.leaves] = chars
        self.tokens[self.width : self.width + self.leaves] = tokens
        level = self.width
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, offset: int) -> tuple[int, int]:
        """(leaf, where it begins) of the leaf that holds a character; the last leaf for the text's end."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if offset - begin >= self.chars[node] and self.chars[node + 1]:
                begin += int(self.chars[node])
                node += 1
        return node - self.width, begin

    def begins(self) -> np.ndarray:
        ends = np.cumsum(self.chars[self.width : self.width + self.leaves])
        return ends - self.chars[self.width : self.width + self.leaves]

    def replace(self, first: int, last: int, chars: np.ndarray, tokens: np.ndarray) -> "CountTree":
        """The tree with leaves [first, last) replaced; sums above are renewed, or all if the number of leaves changes."""
        if len(chars) == last - first:
            for i, (c, t) in enumerate(zip(chars.tolist(), tokens.tolist()), self.width + first):
                by_c, by_t = c - int(self.chars[i]), t - int(self.tokens[i])
                while i:
                    self.chars[i] += by_c
                    self.tokens[i] += by_t
                    i >>= 1
            return self
        leaves = slice(self.width, self.width + self.leaves)
        old_c, old_t = self.chars[leaves], self.tokens[leaves]
        return CountTree(np.concatenate([old_c[:first], chars, old_c[last:]]), np.concatenate([old_t[:first], tokens, old_t[last:]]))


def leaf_sums(pieces: list[str], tokens: np.ndarray, leaves: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of the leaves of a run of pre-tokens: of ``LEAF`` each, or spread over so many leaves."""
    chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
    if leaves and leaves <= len(pieces) <= 2 * LEAF * leaves:
        starts = np.arange(leaves) * len(pieces) // leaves
    else:
        starts = np.arange(0, len(pieces), LEAF)
    return _sums(chars, starts), _sums(tokens, starts)


def pattern_of(text: str):
    try:
        text.encode("latin-1")
        return PRETOKEN_LATIN
    except UnicodeEncodeError:
        return PRETOKEN


def pretokens(text: str) -> list[str]:
    return pattern_of(text).findall(text)


def edit(text: str, tree: CountTree, start: int, end: int, new: str, words: Counter) -> tuple[str, CountTree, int]:
    """Text and tree after one edit, and how many characters were encoded for it."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    edited = text[:start] + new + text[end:]
    if not text or not edited:
        pieces = pretokens(edited)
        return edited, CountTree(*leaf_sums(pieces, words.count([pieces])[0])), len(edited)
    first, begin = tree.find(start)
    while first and start - begin < CONTEXT:
        first -= 1
        begin -= int(tree.chars[tree.width + first])
    moved, done = len(new) - (end - start), start + len(new)
    last, old = tree.find(end)  # old leaf starts that a cut may meet again
    if old < end:
        old += int(tree.chars[tree.width + last])
        last += 1
    pieces = []
    place = begin
    for found in pattern_of(edited).finditer(edited, begin):
        pieces.append(found.group())
        place = found.end()
        while last < tree.leaves and old + moved < place:
            old += int(tree.chars[tree.width + last])
            last += 1
        if place >= done and last < tree.leaves and old + moved == place:
            break
    else:
        last = tree.leaves
    chars, tokens = leaf_sums(pieces, words.count([pieces])[0], last - first)
    return edited, tree.replace(first, last, chars, tokens), place - begin


def trees(texts: list[str], words: Counter) -> Iterator[CountTree]:
    """The tree of each text; words of a block of texts are encoded together."""
    begin = chars = 0
    for i, text in enumerate([*texts, None]):
        if text is None or chars > BLOCK_CHARS:
            pieces = [pretokens(t) for t in texts[begin:i]]
            for part, tokens in zip(pieces, words.count(pieces) if pieces else []):
                yield CountTree(*leaf_sums(part, tokens))
            begin, chars = i, 0
        chars += len(text or "")


RESULT = "n_tokens bigint, n_edits bigint, edited_tokens bigint, edited_chars bigint, reencoded_chars bigint"


def recounted(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """Counts before and after each row's ``edits`` (an array of start, end, replacement), and the characters encoded again."""
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{edits}`").cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(tokenizer_file(tokenizer))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[tuple[int, ...]] = []
            for own, tree, wanted in zip(texts, trees(texts, words), batch.column(2)):
                before, again, made = tree.total, 0, 0
                for one in wanted.as_py() or ():
                    if one is None or one["start"] is None or one["end"] is None:
                        continue
                    own, tree, chars = edit(own, tree, one["start"], one["end"], one["replacement"] or "", words)
                    again, made = again + chars, made + 1
                out.append((before, made, tree.total, len(own), again))
            columns = [pa.array([row[i] for row in out], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    return rows.mapInArrow(run, f"doc_id bigint, {RESULT}")


def with_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the array ``edits`` of a table of them (doc_id, place, start, end, replacement), in order of place."""
    one = F.struct("place", "start", "end", "replacement")
    mine = edits.groupBy(F.col("doc_id").alias("_edited")).agg(F.sort_array(F.collect_list(one)).alias("_edits"))
    ordered = F.transform("_edits", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement")))
    rows = docs.join(mine, F.col(f"`{key}`") == F.col("_edited"), "left")
    return rows.select(*(docs[c] for c in docs.columns if c != "edits"), ordered.alias("edits"))

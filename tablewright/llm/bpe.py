"""BPE encoding and decoding by a depth-first walk over the trie of distinct words.

Of every prefix of a word, byte-pair encoding has one last token.  It follows
from shorter prefixes: it is the token that ends there and that the last token
before it tolerates as a neighbour, meaning no merge reaches across the border
of the two while their own merges run.  So a prefix shared by many words is
solved once, and the tokens of a word are read off by stepping back from its
end.

The distinct words of a block, sorted by bytes, are their trie in preorder:
what a word shares with its predecessor is the path the walk is already on.
Only that path is kept in memory.

Nulls count as empty texts; an empty text has no ids and decodes to "".
Repeated rows are encoded again, each on its own.  Special tokens in a text
get their id, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablewright.llm.common import keyed_texts, released, tokenizer_file

#: fixed value: how the byte-level pre-tokenizer cuts texts
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: the same cuts for texts of code points below 256, whose letters, numbers and white space can be listed
_L, _N, _S = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
PRETOKEN_LATIN = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
NEVER = 1 << 60
#: bytes of words and their ids that a task remembers between blocks (with what a dict spends on an entry), and pairs of
#: neighbours (some 100 bytes each); both are refilled, never cut off, and dropped when the task ends
KEPT_BYTES = 32_000_000
ENTRY_BYTES = 200
NEIGHBOURS_KEPT = 250_000
#: characters of text whose words go through the trie together
BLOCK_CHARS = 1_500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free one."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    letters.update({chr(256 + i): b for i, b in enumerate(rest)})
    return letters


class Vocabulary:
    """Tokens, merges and the neighbour test of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        as_bytes = {text: bytes(letters[c] for c in text) for text in spec["model"]["vocab"]}
        self.id_of = {as_bytes[text]: i for text, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for text, i in self.id_of.items():
            self.bytes_of[i] = text
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.size_of = [len(text) for text in self.bytes_of]
        self.rank: dict[tuple[int, int], int] = {}
        self.made_at = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b = self.id_of[as_bytes[left]], self.id_of[as_bytes[right]]
            made = self.id_of[as_bytes[left] + as_bytes[right]]
            self.rank[a, b] = rank
            self.parts[made], self.made_at[made] = (a, b), rank
        self.edge: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.neighbours: dict[int, bool] = {}
        # the byte lengths of the tokens that end in given three (or, of two bytes, two) bytes, longest first
        lengths: dict[bytes, set[int]] = {}
        self.whole: set[int] = set()  # tokens of two and more bytes that encode to themselves
        for text, i in self.id_of.items():
            if len(text) > 1 and self._whole(i):
                self.whole.add(i)
                lengths.setdefault(text[-3:], set()).add(len(text))
        self.lengths = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}
        self.split_special = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special
            else None
        )

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one edge while ``token`` is built, each with the rank of the merge that swallows it."""
        found = self.edge.get((token, side))
        if found is None:
            found, until, part = [], NEVER, token
            while True:
                found.append((part, until))
                pair = self.parts[part]
                if pair is None:
                    break
                until, part = self.made_at[part], pair[side]
            self.edge[token, side] = found
        return found

    def _crossings(self, a: int, b: int, skip: int = -1) -> bool:
        """Whether some merge across the border of ``a`` and ``b`` comes before the merges that would prevent it."""
        rank = self.rank
        for x, x_until in self._border(a, 1):
            for y, y_until in self._border(b, 0):
                at = rank.get((x, y))
                # equal ranks are overlapping equal pairs, of which the left one is merged
                if at is not None and at != skip and at < x_until and at <= y_until:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether the bytes of ``token`` encode to just that token."""
        pair = self.parts[token]
        return pair is None or not self._crossings(*pair, skip=self.made_at[token])

    def tolerates(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.neighbours.get(key)
        if known is None:
            if len(self.neighbours) >= NEIGHBOURS_KEPT:
                self.neighbours.clear()
            known = self.neighbours[key] = not self._crossings(a, b)
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Every distinct word once, in byte order, with its ids: the depth-first walk over their trie."""
        id_of, lengths, neighbours = self.id_of, self.lengths, self.neighbours
        tolerates, whole = self.tolerates, self.whole
        size_of = self.size_of
        last = [0]  # last[i]: the last token of the first i bytes on the path
        before = b""
        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word), len(last) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                token = -1
                for length in lengths.get(word[end - 3 : end], ()) if end > 2 else ():
                    start = end - length
                    if start < 0:
                        continue
                    found = id_of.get(word[start:end])
                    if found is None:
                        continue
                    if start:
                        left = last[start]
                        good = neighbours.get(left << 20 | found)
                        if not (tolerates(left, found) if good is None else good):
                            continue
                    elif found not in whole:
                        continue
                    token = found
                    break
                if token < 0 and end > 1:
                    found = id_of.get(word[end - 2 : end])
                    if found in whole and (end == 2 or tolerates(last[end - 2], found)):
                        token = found
                last.append(id_of[word[end - 1 : end]] if token < 0 else token)
            before, ids, end = word, [], len(word)
            while end:
                ids.append(last[end])
                end -= size_of[last[end]]
            ids.reverse()
            yield word, ids

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text, in order."""
        try:
            text.encode("latin-1")
            cut = PRETOKEN_LATIN.findall
        except UnicodeEncodeError:
            cut = PRETOKEN.findall
        if self.split_special is None or not any(s in text for s in self.special):
            return cut(text)
        found: list[str] = []
        for i, part in enumerate(self.split_special.split(text)):
            found.extend([part] if i % 2 else cut(part))
        return found


#: the vocabulary last used by this Python worker
_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


class Encoder:
    """Ids of texts as packed little-endian unsigned 32-bit integers; remembers words from block to block."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.bytes_of = np.array(self.vocabulary.bytes_of, object)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        block: list[list[str]] = []
        chars = 0
        for text in texts:
            block.append(self.vocabulary.pieces(text))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield from self._encode_block(block)
                block, chars = [], 0
        yield from self._encode_block(block)

    def _encode_block(self, block: list[list[str]]) -> Iterator[bytes]:
        if self.known_bytes > KEPT_BYTES:
            self.known.clear()
            self.known_bytes = 0
        known = self.known
        for text, token in self.vocabulary.special.items():
            known[text] = token.to_bytes(4, "little")
        new = {piece.encode() for piece in set().union(*block).difference(known)}
        for word, ids in self.vocabulary.encode_words(new):
            known[word.decode()] = np.array(ids, "<u4").tobytes()
            self.known_bytes += ENTRY_BYTES + len(word) + 4 * len(ids)
        for pieces in block:
            yield b"".join(map(known.__getitem__, pieces))

    def decode(self, packed: bytes) -> str:
        tokens = self.bytes_of[np.frombuffer(packed, "<u4")]
        return b"".join(tokens.tolist()).decode("utf-8", errors="replace")


def _forget() -> None:
    """Drop what tasks remembered of their texts; the vocabulary itself stays for the next task of the worker."""
    for path in list(_LOADED):
        _LOADED[path].neighbours.clear()
        _LOADED[path].edge.clear()


def encode(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``: the token ids of every whole text as packed little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(tokenizer_file(tokenizer))
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.encode(texts), pa.binary())], ["doc_id", "ids"])

    return keyed_texts(df, key, text).mapInArrow(released(run, _forget), "doc_id bigint, ids binary")


def decode(df: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id`` and ``text`` of what ``encode`` gives; ids that end inside a character give U+FFFD there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(tokenizer_file(tokenizer))
        for batch in batches:
            texts = [own.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(released(run, _forget), "doc_id bigint, text string")


def round_trip(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of what ``encode`` and then ``decode`` give, in one pass: neither ids nor texts leave the Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(tokenizer_file(tokenizer))
        for batch in batches:
            counts, ids, texts = [], [], []
            for packed in own.encode(["" if t is None else t for t in batch.column(1).to_pylist()]):
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(own.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return keyed_texts(df, key, text).mapInArrow(released(run, _forget), schema)

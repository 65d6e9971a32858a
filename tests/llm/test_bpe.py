import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tablewright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want_of(text):
    library = Tokenizer.from_file(PATH)
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_walk_gives_what_the_library_gives():
    rng = random.Random(1)
    parts = ["a", "b", " ", "\n", "é", "'s", "1", "<|endoftext|>", "<|", "!", "aaaa", " the", "—", "日本", "🙂", "́", "\xa0", "ing", "==="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["a" * 5000, "ab" * 3000, " " * 300]
    own = bpe.Encoder(PATH)
    library = Tokenizer.from_file(PATH)
    for text, got in zip(texts, own.encode(texts)):
        assert got == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.decode(got) == text


def test_every_token_of_the_vocabulary_encodes_to_itself_or_as_the_library_says():
    own = bpe.Encoder(PATH)
    words = [w for w in own.vocabulary.bytes_of[:4000] if w]
    walked = dict(own.vocabulary.encode_words(words))
    assert all(b"".join(own.vocabulary.bytes_of[i] for i in ids) == word for word, ids in walked.items())


def test_edges(spark, edges, edge_rows):
    got = sorted(map(tuple, bpe.round_trip(edges).collect()), key=repr)
    want = []
    for i, text, _ in edge_rows:
        ids = want_of(text)
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_encode_then_decode(edges, edge_rows):
    back = bpe.decode(bpe.encode(edges)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((i, t or "") for i, t, _ in edge_rows), key=repr)


def test_empty_table(nothing):
    assert bpe.round_trip(nothing).count() == 0


def test_caches_refill(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 2_000)
    monkeypatch.setattr(bpe, "NEIGHBOURS_KEPT", 3)
    own = bpe.Encoder(PATH)
    texts = ["some words here", "other words there", "some words again"] * 3
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    assert [own.decode(p) for p in own.encode(texts)] == texts

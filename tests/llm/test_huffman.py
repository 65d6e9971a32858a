import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewright.llm import huffman

TOKENIZER = "word_bpe_49k.json"


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 1000, 300)
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (counts * huffman.code_lengths(counts, 40)).sum() == cost
    steep = np.array([1 << i for i in range(30)] + [0])
    lengths = huffman.code_lengths(steep, 8)
    assert lengths.max() == 8 and lengths[-1] == 0 and (2.0 ** -lengths[:-1].astype(float)).sum() == 1


@pytest.mark.parametrize("n", [1, 2, huffman.BLOCK, huffman.BLOCK + 1, 5 * huffman.BLOCK - 3])
def test_blocks_read_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 500)
    codes = huffman.Codes(huffman.code_lengths(np.bincount(ids, minlength=501)))
    payload, checkpoints = codes.write(ids)
    assert (codes.read(payload, checkpoints, n) == ids).all()
    # a block decodes from its checkpoint alone
    last = len(checkpoints) - 1
    tail = codes.read(payload, checkpoints[last:], n - last * huffman.BLOCK)
    assert (tail == ids[last * huffman.BLOCK :]).all()


def want(rows):
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    coded = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows]
    return [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in coded]


def test_files(spark, edges, edge_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(huffman, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(huffman, "SHARD_TOKENS", 5_000)
    folder = f"file://{tmp_path}/files"
    huffman.write_ids(edges, folder, TOKENIZER, end_id=2)
    rows = huffman.read_ids(spark, folder, digest_only=True).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=repr) == sorted(want(edge_rows), key=repr)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    full = huffman.read_ids(spark, folder).collect()
    assert sorted(zlib.crc32(r.ids) for r in full) == sorted(r.ids_crc32 for r in rows)


def test_empty_table(spark, nothing, tmp_path):
    folder = f"file://{tmp_path}/none"
    huffman.write_ids(nothing, folder, TOKENIZER, end_id=2)
    assert huffman.read_ids(spark, folder).count() == 0

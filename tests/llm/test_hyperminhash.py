import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tablewright.llm import hyperminhash
from tablewright.llm.components import components


def shingles(text, width):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent=80):
    """{doc_id: component} of rows with ids, rows of one id counting as one document."""
    sets = [(i, shingles(t, width)) for i, t, _ in rows if i is not None]
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in sets}


def check(rows, got, width):
    want = brute(rows, width)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id or r.doc_id is None)
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=repr) == sorted(((i, len(shingles(t, width))) for i, t, _ in rows), key=repr)


def edited(rng, words, share):
    return " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(999)) if rng.random() < share else w for w in words)


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(9)
    rows, doc = [], 100
    for size in (3, 12, 60, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for copy in range(12):
                rows.append((doc + rng.randrange(3), edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05, 0.1, 0.2])), None))
                doc += 3
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(docs, near_rows, width):
    check(near_rows, hyperminhash.near_duplicates(docs(near_rows), width=width).collect(), width)


def test_strays_are_compared_in_blocks(docs, near_rows, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK_ROWS", 3)
    check(near_rows, hyperminhash.near_duplicates(docs(near_rows), width=2).collect(), 2)


def test_edges(edges, edge_rows, nothing):
    check(edge_rows, hyperminhash.near_duplicates(edges, width=2).collect(), 2)
    assert hyperminhash.near_duplicates(nothing).count() == 0


def test_one_of_each_group_stays(edges, edge_rows):
    kept = hyperminhash.drop_near_duplicates(edges, width=2)
    want = brute(edge_rows, 2)
    worded = {i for i, t, _ in edge_rows if i is not None and shingles(t, 2)}
    expected = sorted(i for i in worded if want[i] == i)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in worded) == expected


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    for size in (4, 40, 4000):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 1 << 62, size).astype(np.uint64)
            x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 62, size // 4).astype(np.uint64)])) for _ in range(2))
            left, right = (hyperminhash.compress(hyperminhash.register_values(s)) for s in (x, y))
            chance = hyperminhash.chance_equal(np.array([len(x)]), np.array([len(y)]))[0]
            estimate = ((left == right).mean() - chance) / (1 - chance)
            errors.append(estimate - len(both) / (2 * len(x) - len(both)))
        assert abs(np.mean(errors)) < 0.03


def test_components_of_a_chain_a_star_and_a_hub(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (7, 7)]
    links += [(2000, 2001), (2001, 2000), (2000, 2001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}, 2001: 2000}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_id_with_several_texts_is_one_document(docs):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    two = [(1, b, "s"), (5, a, "s"), (5, b, "s"), (7, a, "s"), (8, c, "s")]
    got = {(r.doc_id, r.component_id) for r in hyperminhash.near_duplicates(docs(two)).collect()}
    assert got == {(1, 1), (5, 1), (7, 1), (8, 8)}
    assert sorted(r.doc_id for r in hyperminhash.drop_near_duplicates(docs(two)).collect()) == [1, 8]
    three = [(2, a, "s"), (3, b, "s"), (4, c, "s"), (9, a, "s"), (9, b, "s"), (9, c, "s"), (6, d, "s")]
    got = {(r.doc_id, r.component_id) for r in hyperminhash.near_duplicates(docs(three)).collect()}
    assert got == {(2, 2), (3, 2), (4, 2), (9, 2), (6, 6)}


def test_a_large_class_is_dealt_out(docs, near_rows, monkeypatch):
    monkeypatch.setattr(hyperminhash, "SHARES", 20)
    rows = near_rows + [(5_000 + i, near_rows[0][1], "s") for i in range(60)] + [(9_000 + i, "", "s") for i in range(60)]
    check(rows, hyperminhash.near_duplicates(docs(rows), width=2).collect(), 2)

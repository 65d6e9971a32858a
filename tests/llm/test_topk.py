import math

import numpy as np
import pytest

from tablewright.llm import topk

SCHEMA = "vec_id long, vector array<float>"


def clamp(x):
    return max(-(1 << 63), min(x, (1 << 63) - 1))


def brute(rows, queries, k, scale=64):
    def whole(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [clamp(math.floor(float(np.float32(x)) * scale)) for x in v]

    data = [(i, whole(v)) for i, v in rows]
    found = []
    for q, v in queries:
        own = whole(v)
        if own is None:
            continue
        scored = sorted((-clamp(sum(a * b for a, b in zip(own, w))), i) for i, w in data if w is not None and i != q and len(w) == len(own))
        found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(found)


def check(spark, rows, k):
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, df.where("vec_id % 5 = 0"), k=k)
    assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] % 5 == 0], k)


@pytest.mark.parametrize("dims,clusters", [(64, 1), (17, 6), (3, 2)])
def test_equals_brute_force(spark, monkeypatch, dims, clusters):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 200)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(dims)
    centres = rng.standard_normal((clusters, dims))
    x = centres[rng.integers(0, clusters, 900)] + 0.3 * rng.standard_normal((900, dims))
    check(spark, [(i, v.tolist()) for i, v in enumerate(x)], 7)


def test_ties_repeats_and_odd_vectors(spark):
    rows = [(i, [1.0, 1.0]) for i in range(40)] + [(50, None), (55, [float("nan"), 1.0]), (60, [None, 1.0]), (65, [float("inf"), 1.0])]
    rows += [(70, [0.0, 0.0]), (75, []), (80, [1.0, 2.0, 3.0]), (81, [2.0, 2.0, 2.0]), (82, [-1.0, -5.0])]
    check(spark, rows, 5)


def test_large_components_stay_exact(spark):
    check(spark, [(i, [1e12 + i * 1e7, -3e11, 7.0 * i]) for i in range(12)], 4)
    check(spark, [(i, [3e38, -5e37 * i]) for i in range(6)], 4)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty, empty).count() == 0
    single = spark.createDataFrame([(0, [1.0])], SCHEMA)
    assert topk.top_k(single, single).count() == 0


def test_rows_without_an_id_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame([(None, [99.0, 99.0])] + rows[:15] + [(None, [1.0, 1.0])] + rows[15:], SCHEMA).coalesce(1)
    got = topk.top_k(df, df.where("vec_id % 5 = 0"), k=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] % 5 == 0], 4)


def test_queries_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(topk, "PASS_BYTES", 300)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4 if i % 7 else 3).astype(np.float32)]) for i in range(120)]
    check(spark, rows, 5)

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import mixing


def brute_targets(sizes):
    """{source: target} by handing out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return {**share, **{s: 3 * sizes[s] for s in capped}}
        capped |= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    want = brute_targets(sizes)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        longest[r.source] = max(longest[r.source], r.size)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= longest[source]
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((i, words(t)) for i, t, _ in rows), key=repr)


def test_edges(edges, edge_rows):
    got = mixing.copies(edges).collect()
    check(edge_rows, got)
    again = mixing.copies(edges.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_many_blocks_and_levels_stay_near_their_targets(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    monkeypatch.setattr(mixing, "POOL", 4)
    rows = [(i, "w " * (1 + i * i % 37), "hot" if i % 3 else f"s{i % 5}") for i in range(1500)]
    got = mixing.copies(docs(rows)).collect()
    check(rows, got)


def test_chances_are_kept_on_average(docs, monkeypatch):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(40)]
    total, runs = defaultdict(int), 25
    for seed in range(runs):
        monkeypatch.setattr(mixing, "SEED", 1000 + seed)
        for r in mixing.copies(docs(rows).coalesce(1)).collect():
            total[r.doc_id] += r.copies
            ratio = r.target / r.source_size
    by_source = [sum(total[i] for i in range(40) if i % 4 == s) / runs / 10 for s in range(4)]
    assert max(by_source) <= 3 and sum(by_source) > 2 and ratio > 0


def test_without_broadcast(docs, edge_rows, edges, monkeypatch):
    plain = sorted(map(str, mixing.copies(edges).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.copies(edges).collect())) == plain


def test_mixed_rows_follow_the_copies(edges):
    counts = mixing.copies(edges).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0")
    rows = mixing.mixed(edges)
    assert rows.columns == edges.columns
    assert sorted(map(tuple, rows.groupBy("doc_id").count().collect()), key=repr) == sorted(map(tuple, counts.collect()), key=repr)


def test_no_rows_and_no_words(nothing, docs):
    assert mixing.copies(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    blank = mixing.copies(docs([(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.copies, r.target) for r in blank] == [(0, 0.0)] * 2


def test_plan_has_no_python(edges):
    plan = mixing.copies(edges)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))

import random
import zlib

import pytest

from tablewright.llm import toxicity
from tablewright.llm.queries import QUERIES
from tests_llm_tables import SF_DIR, needs_tables

BAD = ["scoundrel", "villain", "blockhead"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(["ta", "ri", "mo", "len", "du", "sha"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 80))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark, docs):
    rows = corpus(600, 1)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    return toxicity.fit(docs([(i, t, None) for i, t, _ in rows]), labels)


def test_held_out_accuracy(docs, fitted):
    rows = corpus(400, 2)
    found = {r.doc_id: r.score for r in toxicity.scores(docs([(i, t, None) for i, t, _ in rows]), fitted).collect()}
    right = sum((found[i] >= 0.5) == bool(y) for i, _, y in rows)
    assert right >= 0.98 * len(rows)


def test_misspelling_shares_ngrams(fitted):
    scorer = toxicity.Scorer(fitted.gram_scores(), fitted.bias, fitted.prior)
    bad, near, clean = scorer.score(["scoundrel", "scoundrell", "tarimo"])
    assert bad > 0.5 and near > 0.5 > clean


def test_edges(edges, edge_rows, nothing, fitted):
    found = toxicity.scores(edges, fitted).collect()
    assert len(found) == len(edge_rows) and all(0 <= r.score <= 1 for r in found)
    blank = {r.doc_id: r.score for r in found if r.doc_id in (1, 2, 3)}
    assert len(set(blank.values())) == 1
    assert toxicity.scores(nothing, fitted).count() == 0
    kept = toxicity.drop_toxic(edges, fitted)
    assert kept.schema == edges.schema and kept.count() == sum(r.score < 0.5 for r in found)


def test_one_class_or_no_labels(spark, docs):
    rows = docs([(i, f"word{i}", None) for i in range(10)])
    one = spark.createDataFrame([(i, 0) for i in range(10)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scores(rows, toxicity.fit(rows, one)).collect()} == {0.0}
    assert {r.score for r in toxicity.scores(rows, toxicity.fit(rows, one.limit(0))).collect()} == {0.0}


@needs_tables
def test_query_never_learns_held_out_labels(spark):
    rows = QUERIES["op7_toxicity"](spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)

import random

import pytest

#: names that operators use for columns of their own
CLASHES = ["score", "rep", "rank", "ids", "block", "key", "edits_", "row_hash", "component_id", "_row", "_key", "size"]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text, source) rows, with extra columns named like the operators' own."""

    def build(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)
        full = [(i, t, None, s, None, *["x"] * len(CLASHES)) for i, t, s in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "éclair", "naïve", "日本", "x1", "don't", "<|endoftext|>", "…"]
    long = " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(60_000))
    rows = [(1, None, "s1"), (2, "", "s1"), (3, " \t\n", None), (4, "one", "s2"), (5, "one", "s2"), (5, "one", "s2"), (None, "one", "s2")]
    rows += [(6, long, "s3"), (7, long + " tail", None), (8, "word " * 300, "s3"), (9, "A b", "s1"), (10, "a B", "s1")]
    rows += [(20 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), rng.choice(["s1", "s2", None])) for i in range(40)]
    return rows


@pytest.fixture
def edges(docs, edge_rows):
    return docs(edge_rows)


@pytest.fixture
def nothing(docs):
    return docs([])

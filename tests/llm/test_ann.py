import numpy as np
import pytest

from tablewright.llm import ann

SCHEMA = "vec_id long, vector array<float>"


def brute(ids, x, q, k):
    far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    far[ids == ids[q]] = np.inf
    order = np.lexsort((ids, far))[:k]
    return [(int(ids[i]), far[i]) for i in order]


@pytest.fixture(scope="module")
def searched(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2500, 24)).astype(np.float32)
    x[2000:2100] = x[5]  # many copies of one vector
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = ann.nearest(rows, rows.where("vec_id % 50 = 0"), k=10, rounds=3)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return x.astype(np.float64), found


def test_recall_and_exact_scores(searched):
    x, found = searched
    hits = 0
    for q, ranks in found.items():
        assert sorted(ranks) == list(range(1, 11))
        want = brute(np.arange(len(x)), x, q, 10)
        hits += len({v for v, _ in ranks.values()} & {v for v, _ in want})
        for v, score in ranks.values():
            assert score == pytest.approx(np.sqrt(((x[v] - x[q]) ** 2).sum()), rel=1e-12) and v != q
    assert len(found) == 50 and hits / 500 >= 0.9


def test_copies_come_in_order_of_their_ids(searched):
    _, found = searched
    assert [found[2050][r][0] for r in range(1, 11)] == [5, *range(2000, 2009)]


def test_odd_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0])]
    rows += [(7, [float("inf"), 0.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, ann.nearest(df, df, k=10).collect()))
    assert {(q, v) for q, _, v, _ in got} == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)}
    empty = df.where("vec_id > 99")
    assert ann.nearest(empty, empty).count() == 0
    # a query that is no row of the index
    other = spark.createDataFrame([(77, [1.1, 2.1])], SCHEMA)
    assert [r.vec_id for r in ann.nearest(df, other, k=2).orderBy("rank").collect()] == [0, 1]


@pytest.mark.parametrize("huge", [1e8, 1e30])
def test_one_huge_vector_leaves_the_graph_of_the_others(spark, monkeypatch, huge):
    x = np.random.default_rng(3).standard_normal((1200, 24)).astype(np.float32)
    x[7] = 0
    x[7, 2] = huge
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    build, lists = ann.neighbour_graph, {}

    class Built(Exception):
        pass

    def kept(*args):
        lists.update((r.id, set(r.near)) for r in build(*args).collect())
        raise Built

    monkeypatch.setattr(ann, "neighbour_graph", kept)
    with pytest.raises(Built):
        ann.nearest(rows, rows, k=10, rounds=2)
    x = x.astype(np.float64)
    hits = sum(len(lists[q] & {v for v, _ in brute(np.arange(len(x)), x, q, 10)}) for q in range(0, 1200, 40))
    assert hits / 300 >= 0.9


def test_a_narrow_first_beam_still_gives_the_recall_asked_for(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1200, 24)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    found = {}
    for r in ann.nearest(rows, rows.where("vec_id % 40 = 0"), k=10, neighbours=4, rounds=1, beam=11).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float64)
    hits = sum(len(found[q] & {v for v, _ in brute(np.arange(len(x)), x, q, 10)}) for q in range(0, 1200, 40))
    assert hits / 300 >= 0.95


def test_all_members_of_a_large_centre_meet(spark):
    n = 300
    x = np.random.default_rng(5).standard_normal((n, 4)).astype("<f4")
    packed = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, packed binary")
    # all list vector 0 alone, so each has all others as neighbours of its neighbour
    graph = spark.createDataFrame([(i, [0], [1e9], [True]) for i in range(1, n)], "id long, near array<long>, far array<double>, fresh array<boolean>")
    found = {}
    for r in ann.local_join(graph, packed, 0).collect():
        found.setdefault(r.id, {}).update(zip(r.near, r.far))
    x = x.astype(np.float64)
    for i in range(1, n):
        far = ((x[1:] - x[i]) ** 2).sum(axis=1)
        far[i - 1] = np.inf
        assert int(far.argmin()) + 1 in found[i]


def test_parts_that_no_way_joins_are_searched_row_by_row(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 8))
    x[300:] += 1e3  # no edge leads there, and no query starts there
    monkeypatch.setattr(ann, "PIVOTS", 1)
    monkeypatch.setattr(ann, "PASS", 7)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    asked = spark.createDataFrame([(1000 + i, (x[i] + 0.01).tolist()) for i in range(0, 600, 30)], "vec_id long, vector array<double>")
    found = {}
    for r in ann.nearest(rows, asked, k=10).collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in range(0, 600, 30):
        far = np.sqrt(((x - (x[q] + 0.01)) ** 2).sum(axis=1))
        assert [found[1000 + q][r] for r in range(1, 11)] == np.argsort(far, kind="stable")[:10].tolist()


def test_lengths_whose_squares_leave_the_range_of_doubles(spark):
    x = np.array([[3e200, 4e200], [3e-200, 4e-200], [3.0, 4.0], [0.0, 0.0], [3e307, 4e307]])
    assert ann._lengths(x).tolist() == pytest.approx([5e200, 5e-200, 5.0, 0.0, 5e307], rel=1e-15)
    rows = spark.createDataFrame([(i, [1e200 * i, 1e200]) for i in range(1, 6)], "vec_id long, vector array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(rows, rows.where("vec_id = 1"), k=3).collect()}
    assert got == {(1, 1): (2, 1e200), (1, 2): (3, 2e200), (1, 3): (4, pytest.approx(3e200))}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_the_graph_takes_few_shuffles(spark, monkeypatch):
    x = np.random.default_rng(9).standard_normal((2500, 8)).astype("<f4")
    packed = ann.stage(spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, packed binary"))
    plans = []
    merged = ann.merged

    def planned(lists, keep):
        out = merged(lists, keep)
        plans.append(exchanges(out))
        return out

    monkeypatch.setattr(ann, "merged", planned)
    graph = ann.neighbour_graph(packed, 2500, 8, rounds=1)
    first, step = plans
    # whatever the number of starting groups; every shuffle of a small index costs as much as its tasks
    assert first <= 4 and step <= 7
    assert exchanges(ann.adjacency(graph)) <= 2


def test_a_query_walks_through_a_bucket_in_one_round(spark, monkeypatch):
    n, staged, stage = 40, [], ann.stage
    monkeypatch.setattr(ann, "PIVOTS", 1)
    monkeypatch.setattr(ann, "stage", lambda df, label="stage": staged.append(label) or stage(df, label))
    index = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "id long, vector array<double>")
    links = spark.createDataFrame([(i, [j for j in (i - 1, i + 1) if 0 <= j < n]) for i in range(n)], "id long, links array<long>")
    asked = spark.createDataFrame([(100, [0.0, 1.0], None, 3), (101, [n - 1.0, 1.0], None, 3)], "query long, vector array<double>, own long, beam int")
    found = {r.query: r for r in ann.search(index, ann.placed_nodes(index, links, n), asked, n).collect()}
    assert found[100].ids == [0, 1, 2] and found[101].ids == [39, 38, 37] and found[101].far == [0, 1, 2]
    assert staged.count("beams") == 2


def test_queries_travel_between_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET", 64)
    x = np.random.default_rng(10).standard_normal((700, 16)).astype(np.float32)
    ids = np.arange(700) * 7 - 2100  # negative ones, too
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    found = {}
    for r in ann.nearest(rows, rows.where("vec_id % 35 = 0"), k=10, neighbours=8, rounds=2).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    x, hits = x.astype(np.float64), 0
    for q in np.flatnonzero(ids % 35 == 0):
        want = brute(ids, x, q, 10)
        hits += len({v for v, _ in found[ids[q]].values()} & {v for v, _ in want})
    assert len(found) == 140 and hits / 1400 >= 0.9


def test_edges_known_before_stay_known(spark):
    lists = [(1, [3, 4], [2.0, 1.5], True), (1, [2, 3], [1.0, 2.0], False), (1, [4], [1.5], True), (2, [], [], True), (-5, [9], [0.5], True)]
    given = spark.createDataFrame(lists, "id long, near array<long>, far array<double>, fresh boolean")
    got = {r.id: (r.near, r.far, r.fresh) for r in ann.merged(given, 3).collect()}
    assert got == {1: ([2, 4, 3], [1.0, 1.5, 2.0], [False, True, False]), -5: ([9], [0.5], [True])}


def test_members_of_a_centre_are_drawn_anew_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(ann, "REVERSE", 5)
    graph = [(0, [100, 101], [1.0, 1.0], [True, False])] + [(i, [0], [1.0], [i == 7]) for i in range(1, 40)]
    graph = spark.createDataFrame(graph, "id long, near array<long>, far array<double>, fresh array<boolean>")
    drawn = []
    for step in (0, 1):
        members = {r.centre: {(m.member, m.new) for m in r.members} for r in ann._centres(graph, step).collect()}
        assert members[100] == {(0, True)} and members[1] == {(0, False)} and len(members) == 42
        assert {(100, True), (101, False)} <= members[0] and len(members[0]) == 7
        drawn.append(members[0])
    assert drawn[0] != drawn[1]

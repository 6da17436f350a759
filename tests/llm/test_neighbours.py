import numpy as np
import pytest

from jsonloom.llm import neighbours as N

SCHEMA = "no bigint, v array<float>, id string"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v] if v is not None else None, "clash") for i, v in zip(ids, x)], SCHEMA)


def brute(ids, x, k):
    x = np.asarray(x, float)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out[ids[i]] = {ids[j] for j in order}
    return out


def test_recall_and_results(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 100)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))
    ids = list(range(10, 910))
    df = frame(spark, ids, x)
    want = brute(ids, np.float32(x), 10)
    got = {}
    for r in N.similar_rows(df, "no", "v", 16, 10).collect():
        got.setdefault(r["a"], set()).add(r["b"])
    assert set(got) == set(ids) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[i] & want[i]) / 10 for i in ids]) >= 0.95
    some = N.similar_rows(df, "no", "v", 16, 10, ask=N.F.col("id") % 20 == 0).select("a").distinct().count()
    assert some == 45


def found(spark, x, k, **kw):
    got = {}
    for r in N.similar_rows(frame(spark, range(len(x)), x), "no", "v", x.shape[1], k, **kw).collect():
        got.setdefault(r["a"], set()).add(r["b"])
    return got


def recall_of(got, want, k):
    return np.mean([len(got[i] & want[i]) / k for i in want])


def test_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 12))
    tree = N.Tree(np.float32(x), 20)
    home = tree.homes(x)
    assert np.bincount(home, minlength=tree.leaves).max() <= 20
    row, nth, leaf, far = tree.visits(x[:50], np.inf)
    for i in range(50):
        own = row == i
        assert sorted(leaf[own]) == list(range(tree.leaves)) and leaf[own][nth[own].argmin()] == home[i]  # each leaf once
        # no row of a leaf is nearer than the leaf
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        by_leaf = dict(zip(leaf[own], far[own]))
        assert all(by_leaf[h] <= dd + 1e-4 for h, dd in zip(home, d))
    some = tree.visits(x[:50], 0.3)
    assert set(zip(some[0], some[2])) == {(r, f) for r, f, d in zip(row, leaf, far) if d <= 0.3}
    f, d = tree.distances(x[:50], x[50:100])
    assert list(f) == list(home[50:100]) and np.allclose(d, [far[(row == i) & (leaf == f[i])][0] for i in range(50)])


@pytest.mark.parametrize("sent", [10**6, 0])  # trees broadcast, and met by a shuffle on the cell
def test_cells(spark, monkeypatch, sent):
    for name, v in (("LEAF_ROWS", 40), ("CELL_ROWS", 200), ("CELL_SAMPLE", (60, 4000)), ("SENT", sent)):
        monkeypatch.setattr(N, name, v)
    rng = np.random.default_rng(1)
    x = np.float32(rng.normal(size=(8, 8))[rng.integers(0, 8, 1500)] + 0.5 * rng.normal(size=(1500, 8)))
    want = brute(list(range(1500)), x, 5)
    assert recall_of(found(spark, x, 5, recall=0.98), want, 5) >= 0.95


def test_leaves_grow_with_the_rows(spark, monkeypatch, capsys):
    monkeypatch.setattr(N, "LEAF_ROWS", 50)
    monkeypatch.setattr(N, "CELL_ROWS", 1000)
    leaves = []
    for n in (500, 2000, 8000):
        x = np.float32(np.random.default_rng(n).normal(size=(n, 6)))
        df = frame(spark, range(n), x).select(N.F.col("no").alias("id"), "v")
        index = N.fit(df, 6, 5, 0.9)
        sizes = index.place(df.withColumn("ask", N.F.lit(False)), 6, index.reach).groupBy("cell", "leaf").count().toPandas()["count"]
        assert sizes.max() <= 4 * N.LEAF_ROWS and sizes.sum() == n and index.recall >= 0.9
        leaves.append(index.leaves)
    assert leaves[1] > 2 * leaves[0] and leaves[2] > 2 * leaves[1]


def test_crowded_leaves_are_processed_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.float32(rng.normal(size=(400, 8)))
    monkeypatch.setattr(N, "LEAF_ROWS", 50)
    want = found(spark, x, 5, recall=1.0)
    monkeypatch.setattr(N, "CROWD", 30)
    assert found(spark, x, 5, recall=1.0) == want  # the same, in parts
    alike = np.float32(np.outer(np.arange(1, 601), rng.normal(size=8)))  # one direction
    got = found(spark, alike, 5)
    assert len(got) == 600 and all(len(v) == 5 for v in got.values())


def test_copies_ties_and_unusable_rows(spark):
    good = [[1, 0, 0], [1, 0, 0], [2, 0, 0], [0, 1, 0]] + [[0, 0, 1]] * 30
    bad = [None, [], [1, 2], [0, 0, 0], [float("nan"), 1, 1]]
    df = frame(spark, range(len(good + bad)), good + bad)
    got = {(r["a"], r["b"]) for r in N.similar_rows(df, "no", "v", 3, 10, least=0.9).collect()}
    dup = set(range(4, 34))
    assert {p for p in got if not p[0] in dup} == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)}
    assert {p for p in got if p[0] == 33} == {(33, j) for j in range(4, 14)} and {p for p in got if p[0] == 4} == {(4, j) for j in range(5, 15)}


def test_exact_near_the_threshold(spark):
    a = np.array([1.0, 0.0])
    x = [a] + [[c, np.sqrt(1 - c * c)] for c in (0.9001, 0.8999)]
    got = {(r["a"], r["b"]) for r in N.similar_rows(frame(spark, range(3), x), "no", "v", 2, 10, least=0.9).collect()}
    assert (0, 1) in got and (0, 2) not in got


def test_small_and_empty(spark):
    assert N.similar_rows(frame(spark, [], []), "no", "v", 3, 10, least=0.9).count() == 0
    assert [tuple(r)[:2] for r in N.similar_rows(frame(spark, [1, 2], [[1, 0], [1, 1]]), "no", "v", 2, 10).orderBy("a").collect()] == [(1, 2), (2, 1)]


def test_dense_group_loses_no_neighbour_to_the_codes(spark, monkeypatch):
    # similarities around 0.995 in one group; all leaves are visited, so that only the ranking can lose something
    monkeypatch.setattr(N, "LEAF_ROWS", 200)
    rng = np.random.default_rng(3)
    x = np.float32(rng.normal(size=384) + 0.07 * rng.normal(size=(1200, 384)))
    want = brute(list(range(1200)), x, 10)
    for least in (None, 0.9):
        got = {}
        for r in N.similar_rows(frame(spark, range(1200), x), "no", "v", 384, 10, recall=1.0, least=least).collect():
            got.setdefault(r["a"], set()).add(r["b"])
        assert np.mean([len(got[i] & want[i]) / 10 for i in range(1200)]) >= 0.999


def test_only_neighbours_that_are_asked_for_widen_the_visits(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 30)
    rng = np.random.default_rng(6)
    x = np.float32(rng.normal(size=(900, 24)))
    x[450:] = x[:450] + np.float32(0.05 * rng.normal(size=(450, 24)))  # each with one that is alike
    df = frame(spark, range(900), x).select(N.F.col("no").alias("id"), "v")
    every, alike = N.fit(df, 24, 5, 0.97), N.fit(df, 24, 5, 0.97, least=0.95)
    assert alike.visits < every.visits and alike.recall >= 0.97
    got = {(r["a"], r["b"]) for r in N.similar_rows(frame(spark, range(900), x), "no", "v", 24, 5, least=0.95).collect()}
    assert len(got & {(i, (i + 450) % 900) for i in range(900)}) >= 0.95 * 900


@pytest.mark.parametrize("least", [None, 0.6])
def test_vectors_travel_by_block_and_not_by_leaf(spark, monkeypatch, least):
    monkeypatch.setattr(N, "LEAF_ROWS", 20)
    monkeypatch.setattr(N, "BLOCKS", 4, raising=False)
    x = np.float32(np.random.default_rng(8).normal(size=(1600, 24)))
    x[800:] = x[:800] + np.float32(0.5 * np.random.default_rng(9).normal(size=(800, 24)))
    df = frame(spark, range(1600), x)
    rows = df.select(N.F.col("no").alias("id"), "v")
    index = N.fit(rows, 24, 5, 0.99, least)
    assert index.leaves >= 60 and index.visits > 15
    assert index.place(rows.withColumn("ask", N.F.lit(True)), 24, index.reach).count() <= 8 * 1600
    # the same neighbours however the leaves travel
    unit = np.float64(x) / np.linalg.norm(np.float64(x), axis=1)[:, None]

    def best(index):
        got = {}
        for a, b in N.nearest(rows, 24, 5, index, floor=-2.0 if least is None else least).collect():
            got.setdefault(a, []).append((-unit[a] @ unit[b], b))
        return {a: sorted(of)[:5] for a, of in got.items()}

    blocks = best(index)
    monkeypatch.setattr(N, "BLOCK_LEAVES", 1, raising=False)
    single = N.fit(rows, 24, 5, 0.99, least)
    assert single.reach == index.reach and single.blocks > 3 * index.blocks
    assert best(single) == blocks


def test_a_dense_leaf_is_searched_whole(spark, monkeypatch):
    # exact multiples by powers of two are ties, which go to the smallest ids, whatever the size of a leaf
    v = np.float32(np.random.default_rng(4).normal(size=16))
    x = np.vstack([v * np.float32(2.0) ** j for j in range(-50, 50)] + [np.float32(np.random.default_rng(5).normal(size=(40, 16)))])
    want = {i: set([j for j in range(6) if j != i][:5]) for i in range(100)}
    for size in (1000, 10):
        monkeypatch.setattr(N, "LEAF_ROWS", size)
        for least in (None, 0.9):
            got = found(spark, x, 5, recall=1.0, least=least)
            assert {i: got[i] for i in range(100)} == want

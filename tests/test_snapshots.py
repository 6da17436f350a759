import random

import numpy as np
import pytest

from jsonloom.operators import snapshots as S


def brute(rows, n):
    snaps = sorted({r[0] for r in rows})
    at = {s: {r[1]: r[2:] for r in rows if r[0] == s} for s in snaps}
    out = []
    for a, b in zip(snaps, snaps[1:]):
        for k in at[a].keys() | at[b].keys():
            if k not in at[a]:
                out.append((b, k, "added"))
            elif k not in at[b]:
                out.append((b, k, "removed"))
            elif at[a][k] != at[b][k]:
                out.append((b, k, "changed"))
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = list({(f"s{rnd.randint(0, 5)}", f"k{rnd.randint(0, 80)}"): None for _ in range(300)})
    rows = [(s, k, rnd.choice([None, 1, S.NULL]), rnd.randint(0, 1)) for s, k in rows]
    df = spark.createDataFrame(rows, "snapshot string, key string, a bigint, b bigint")
    # null and the number that stands for it are told apart
    assert sorted(map(tuple, S.snapshot_changes(df, ["a", "b"]).collect())) == brute(rows, 2)


def test_ordinals_persist(spark):
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    first = S.new_ordinals(keys("b", "a"))
    before = {r["key"]: r["ord"] for r in first.collect()}
    later = {r["key"]: r["ord"] for r in S.with_ordinals(keys("a", "0", "c"), first).collect()}
    assert sorted(before.values()) == [0, 1] and later.keys() == {"0", "c"} and sorted(later.values()) == [2, 3]


def test_ordinal_after_a_single_known_key(spark):
    known = spark.createDataFrame([("a", 0)], "key string, ord bigint")
    got = S.with_ordinals(spark.createDataFrame([("a",), ("b",)], "key string"), known)
    assert [tuple(r) for r in got.collect()] == [("b", 1)]


def test_bitmaps():
    rng = np.random.default_rng(5)
    some = lambda n: np.sort(rng.choice(S.BLOCK, n, False))
    sets = [np.zeros(0, np.int64), np.array([0]), np.array([S.BLOCK - 1]), some(50), some(30_000), np.arange(S.BLOCK), np.arange(100, 60_000), np.delete(np.arange(40_000), some(20)[:5] % 40_000)]
    maps = [S.Bitmap.load(S.Bitmap.of(x).dump()) for x in sets]
    assert {m.kind for m in maps} == {S.ARRAY, S.RUNS, S.BITS}
    for x, m in zip(sets, maps):
        assert list(m.values()) == list(x) and list(m.rank(x)) == list(range(len(x)))
        for y, o in zip(sets, maps):
            assert list(m.and_not(o)) == list(np.setdiff1d(x, y)) and list(m.both(o)) == list(np.intersect1d(x, y))


def test_history_meets_only_the_last_snapshot(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(f"s{s}", f"k{k}", rnd.randint(0, 2)) for s in range(5) for k in range(40) if rnd.random() < 0.7]
    df = lambda *names: spark.createDataFrame([r for r in rows if r[0] in names], "snapshot string, key string, a bigint")
    path = str(tmp_path / "history")
    got = []
    for names in (["s0"], ["s1", "s2"], ["s3"], ["s4"]):
        got += map(tuple, S.snapshot_changes(df(*names), ["a"], path).collect())
    assert sorted(got) == brute(rows, 1)
    with pytest.raises(ValueError, match="not later"):
        S.snapshot_changes(df("s4"), ["a"], path)
    assert S.snapshot_changes(df(), ["a"], path).count() == 0


def test_catalog(spark, rows):
    cols = "record_id bigint, catalog_id string, id string, price double, stock_count bigint, inventory_status string, ingested_at timestamp, ord int, snap int"
    import datetime as D

    t = D.datetime(2025, 1, 1)
    data = [
        (1, "A", "p1", 1.001, 5, "in_stock", t, 0, 0), (2, "B", " P1 ", 1.004, 5, " IN_STOCK", t, 0, 0),
        (3, "A", "p2", 1.0, 5, None, t, 0, 0), (4, "B", "p2", 1.0, 5, "x", t, 0, 0),
        (5, "A", "p3", 1.0, 5, "x", t, 0, 0), (6, "B", "p4", 1.0, None, "x", t, 0, 0), (7, "B", " ", 1.0, 5, "x", t, 0, 0),
        (8, "C", "p4", None, None, "x", t, 0, 0), (9, "C", "p4", 1.0, None, "x", t, 0, 0), (10, None, "p9", 1.0, None, "x", t, 0, 0),
    ]
    got = S.catalog_changes(spark.createDataFrame(data, cols))
    assert rows(got) == [("B", "P2", "changed"), ("B", "P3", "removed"), ("B", "P4", "added"), ("C", "P1", "removed"), ("C", "P2", "removed")]
    assert S.catalog_changes(spark.createDataFrame([], cols)).count() == 0

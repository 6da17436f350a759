import random

import pytest

from jsonloom.operators import orphans as O

REFS = "ref_field string, period string, record_id bigint, ref_key string, at bigint, valid_from string"  # a column named like one of the intervals
IV = "ref_field string, ref_key string, valid_from bigint, valid_to bigint"


def brute(refs, iv):
    return sorted(r[:4] for r in refs if not any(i[:2] == (r[0], r[3]) and i[2] is not None and r[4] is not None and i[2] <= r[4] < i[3] for i in iv))


@pytest.mark.parametrize("bound", [10**6, 0])  # broadcast, and heavy keys apart
def test_against_brute_force(spark, bound):
    rnd = random.Random(3)
    refs = [("f", f"2025-0{rnd.randint(1, 9)}", i, "HOT" if i % 3 == 0 else f"K{rnd.randint(0, 60)}", rnd.choice([None, *range(100)]), "x") for i in range(4000)]
    iv = [("f", rnd.choice(["HOT", *[f"K{k}" for k in range(40)]]), rnd.choice([None, *range(90)]), rnd.randint(0, 110)) for _ in range(150)]
    got = O.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(iv, IV), broadcast_rows=bound)
    want = brute(refs, iv)
    assert sorted(tuple(r)[:4] for r in got.select("ref_field", "period", "record_id", "ref_key").collect()) == want
    report = {r["period"]: (r["refs"], r["orphans"], r["orphan_keys"]) for r in O.orphan_report(spark.createDataFrame(refs, REFS), spark.createDataFrame(iv, IV), broadcast_rows=bound).collect()}
    for p in {r[1] for r in refs}:
        own = [w for w in want if w[1] == p]
        assert report[p] == (sum(r[1] == p for r in refs), len(own), len({w[3] for w in own}))


def test_only_unsettled_groups_are_looked_at_one_by_one(spark):
    refs = [("f", "p1", 1, "IN", 10, "x"), ("f", "p1", 2, "IN", 20, "x"), ("f", "p1", 3, "OUT", 10, "x"), ("f", "p1", 4, "EDGE", 10, "x"), ("f", "p1", 5, "EDGE", 30, "x"), ("f", "p2", 6, "IN", None, "x"), ("f", None, 7, "IN", 10, "x"), ("f", None, 8, "OUT", 10, "x")]
    iv = [("f", "IN", 0, 15), ("f", "IN", 15, 40), ("f", "OUT", 50, 60), ("f", "EDGE", 20, 40)]
    o = O.Orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(iv, IV))
    assert {(r["ref_key"], r["period"]): r["state"] for r in o.groups.collect()} == {("IN", "p1"): "sound", ("OUT", "p1"): "orphan", ("EDGE", "p1"): "mixed", ("IN", "p2"): "orphan", ("IN", None): "sound", ("OUT", None): "orphan"}
    assert sorted(r["record_id"] for r in o.rows().collect()) == [3, 4, 6, 8]


def test_intervals_are_merged(spark, rows):
    iv = [("f", "A", 1, 5), ("f", "A", 1, 3), ("f", "A", 5, 7), ("f", "A", 9, 12), ("f", "A", 10, 11), ("f", "A", 4, 4), ("f", "B", 2, O.FOREVER)]
    assert rows(O.merge_intervals(spark.createDataFrame(iv, IV)).select("ref_key", "valid_from", "valid_to")) == [("A", 1, 7), ("A", 9, 12), ("B", 2, O.FOREVER)]


def test_empty(spark):
    none, some = spark.createDataFrame([], REFS), spark.createDataFrame([("f", "2025-01", 1, "A", 3, "x")], REFS)
    iv = spark.createDataFrame([], IV)
    assert O.find_orphans(none, iv).count() == 0
    assert O.find_orphans(some, iv).count() == 1
    assert [tuple(r) for r in O.orphan_report(some, iv).collect()] == [("f", "2025-01", 1, 1, 1)]

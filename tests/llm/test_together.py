import itertools
import math
import random
from collections import Counter

import pytest

from jsonloom.llm import together as T


def brute(baskets, support, lift):
    sets = [{x for x in b or [] if x is not None} for b in baskets]
    one = Counter(x for s in sets for x in s)
    two = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    return {(a, b): n for (a, b), n in two.items() if n >= support and n * len(sets) / (one[a] * one[b]) >= lift}


@pytest.mark.parametrize("wide,held,bound", [(1000, 500_000, 200_000), (3, 5, 200_000), (1000, 7, 0)])
def test_against_brute_force(spark, monkeypatch, wide, held, bound):
    monkeypatch.setattr(T, "WIDE", wide)
    monkeypatch.setattr(T, "HELD", held)
    monkeypatch.setattr(T, "BROADCAST_ROWS", bound)
    rnd = random.Random(6)
    baskets = [rnd.choice([None, [], [None], *[[rnd.choice(["hot", f"p{rnd.randint(0, 30)}", None]) for _ in range(rnd.randint(1, 9))] for _ in range(9)]]) for _ in range(400)]
    df = spark.createDataFrame([(b, "x") for b in baskets], "items array<string>, item_a string")
    for support, lift in ((1, 0.0), (3, 1.2)):
        got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in T.pairs_together(df, "items", support, lift).collect()}
        assert got == brute(baskets, support, lift)


def test_significance(spark):
    df = spark.createDataFrame([(["a", "b"],)] * 10 + [(["a"],)] * 5 + [(["c"],)] * 85, "items array<string>")
    r = T.pairs_together(df, "items").first()
    g = lambda *k: sum(x * math.log(x) for x in k if x)
    want = 2 * (g(10, 5, 0, 85) + g(100) - g(15, 85) - g(10, 90))
    assert (r["n_a"], r["n_b"], r["n_all"]) == (15, 10, 100) and abs(r["llr"] - want) < 1e-9 and abs(r["lift"] - 10 * 100 / 150) < 1e-12


def test_empty(spark):
    assert T.pairs_together(spark.createDataFrame([], "items array<string>"), "items").count() == 0


def test_orders_as_they_stand(spark):
    import datetime as D

    t = lambda h: D.datetime(2025, 1, 1, h)
    item = lambda *ps: [{"product_id": p, "sku": None} for p in ps]
    rows = [(1, "o", t(1), item("a", "b")), (2, "o", t(2), item(" A", None, "a", " ")), (3, None, t(1), item("x")), (4, "q", t(1), None)]
    df = spark.createDataFrame(rows, "record_id bigint, order_id string, ingested_at timestamp, items array<struct<product_id:string,sku:string>>")
    got = sorted(([x for x in r["products"] or []] for r in T.order_baskets(df).collect()), key=str)
    assert got == [["A", None, "A", None], []]


def test_registered_pairs_are_all_pairs(spark, tmp_path):
    import datetime as D

    from jsonloom.llm.registry import queries

    rows = [(n, f"o{n}", D.datetime(2025, 1, 1), [{"product_id": p, "sku": None} for p in ps]) for n, ps in enumerate(["ab"] * 6 + ["ac"] * 4 + ["bd"])]
    spark.createDataFrame(rows, "record_id bigint, order_id string, ingested_at timestamp, items array<struct<product_id:string,sku:string>>").write.parquet(str(tmp_path / "order_transactions.parquet"))
    got = {(r["product_a"], r["product_b"]): (r["n_ab"], r["lift"]) for r in queries()["p5_all"](spark, str(tmp_path)).collect()}
    assert got == {("A", "B"): (6, round(6 * 11 / (10 * 7), 6)), ("A", "C"): (4, round(4 * 11 / (10 * 4), 6)), ("B", "D"): (1, round(11 / 7, 6))}

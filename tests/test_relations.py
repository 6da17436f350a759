import random

from jsonloom.operators import relations as R
from jsonloom.operators import retrieval
from jsonloom.operators.intervals import within
from jsonloom.operators.retrieval import assemble_context, nearest, nearest_each

DAY = R.DAY


def test_explicit(spark):
    f = spark.createDataFrame([("a", 1, "id", "X"), ("b", 2, "ref", "X"), ("c", 3, "user_id", "X"), ("b", 2, "code", "AB-12"), ("d", 4, "code", "AB-12"), ("e", 5, "t", None), ("e", 5, "t", "nothing")], "chunk string, ordinal int, member string, value string")
    got = sorted((r["source"], r["target"]) for r in R.explicit_edges(f).collect())
    assert got == [("a", "c"), ("b", "c"), ("b", "d")]


def test_temporal_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(f"c{rnd.randint(0, 14)}", rnd.choice("gh"), rnd.choice([None, rnd.randint(0, 200 * DAY)])) for _ in range(60)]
    got = {(r["source"], r["target"]) for r in R.temporal_edges(spark.createDataFrame(rows, "chunk string, g string, at bigint"), ["g"]).collect()}
    want = set()
    for g in "gh":
        times = {}
        for c, x, t in rows:
            if x == g and t is not None:
                times.setdefault(c, []).append(t)
        for a in times:
            for b in times:
                if (min(times[a]), a) < (min(times[b]), b) and min(abs(x - y) for x in times[a] for y in times[b]) < 31 * DAY:
                    want.add((a, b))
    assert got == want


def test_semantic_links(spark):
    d = spark.createDataFrame([(1, "f", "An Invoice"), (2, "f", "customer order"), (3, "f", "buyer of a product"), (4, "g", "invoice"), (5, "f", None)], "chunk bigint, file string, text string")
    got = sorted((r["chunk"], r["source_class"], r["target_class"], r["links"]) for r in R.semantic_links(d, ["file"]).collect())
    assert got == [(1, "invoice_ledger", "customer_order", 2), (2, "customer_order", "invoice_ledger", 1), (2, "customer_order", "product_inventory", 1), (3, "customer_order", "invoice_ledger", 1), (3, "product_inventory", "customer_order", 1)]


def test_references(spark, rows):
    leaves = spark.createDataFrame([("c1", 1, "user.id", "U1"), ("c2", 2, "paid", "U2"), ("c3", 3, "name", "U3"), ("c4", 4, "x.user_id", "U1")], "chunk string, ordinal int, path string, value string")
    ctx = spark.createDataFrame([("z", "p", "products_id", "U1"), ("z", "p", "id", "U2"), ("z", "p", "id", "U3")], "chunk string, path string, field string, value string")
    assert rows(R.reference_edges(leaves, ctx).select("source", "target", "relationship_type")) == [("z", "c2", "reference"), ("z", "c4", "product_reference")]


def test_graph(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "d")], "source string, target string")
    s = spark.createDataFrame([("a",), ("d",)], "chunk string")
    assert rows(R.expand(e, s)) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]
    assert rows(R.expand(e, s, 2, 1)) == [("a", "b", 1)]
    full = e.selectExpr("*", "'x' as relationship_type", "1.0D as confidence", "'' as metadata")
    assert R.top_edges(full, 1).count() == 4 and R.touching(full, s.withColumnRenamed("chunk", "chunk")).count() == 1


def test_within(spark):
    left = spark.createDataFrame([("k", 10, 1), ("k", None, 2), (None, 10, 3)], "key string, at bigint, id int")
    right = spark.createDataFrame([("k", 15, 7), ("k", 16, 8), ("k", 5, 9), (None, 10, 1)], "key string, at bigint, id int")
    assert sorted((r["id"], r["id_right"], r["gap"]) for r in within(left, right, "key", "at", 5).collect()) == [(1, 7, 5), (1, 9, -5)]


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0])], "id bigint, v array<float>")
    assert [r["id"] for r in nearest(v, "v", [1.0, 0.0], 3).collect()] == [1, 6, 3]
    assert [r["id"] for r in nearest(v, "v", [0.0, 0.0], 2, "l2").collect()] == [5, 1]
    q = v.selectExpr("id as q", "v as qv").where("id in (1, 4, 5)")
    assert sorted((r["q"], r["id"], r["rank"]) for r in nearest_each(q, v, 2).collect()) == [(1, 3, 2), (1, 6, 1)]
    assert nearest_each(q.limit(0), v).count() == 0 and nearest_each(q, v.limit(0)).count() == 0


def test_blocks_of_queries_as_one(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, None if i % 17 == 0 else [rnd.gauss(0, 1) for _ in range(3 if i % 5 else 2)]) for i in range(300)]
    v = spark.createDataFrame(rows, "id bigint, v array<float>")
    q = v.where("id % 3 = 0").selectExpr("id as q", "v as qv")
    plain = lambda: sorted(map(tuple, nearest_each(q, v, 4).collect()))
    want = plain()
    monkeypatch.setattr(retrieval, "BLOCK", 10)
    assert plain() == want and want


def test_context(spark):
    c = spark.createDataFrame([("g", 1, "a b c d", 0.9), ("g", 2, "e f g h", 0.9), ("g", 3, "i", 0.9), ("g", 4, "x y", 0.7), ("g", 5, "z", None), ("g", 6, None, 0.1)], "g string, ordinal int, text string, score double")
    got = sorted((r["ordinal"], r["tokens_before"]) for r in assemble_context(c, ["g"], 10).collect())
    assert got == [(1, 0), (2, 4), (4, 8)]


def test_context_of_a_large_group(spark):
    rnd = random.Random(3)
    rows = [("g", i, " ".join("w" * rnd.randint(0, 3)), rnd.choice([0.9, 0.7, 0.1])) for i in rnd.sample(range(10**6), 3000)]
    got = sorted((r["ordinal"], r["tokens_before"]) for r in assemble_context(spark.createDataFrame(rows, "g string, ordinal int, text string, score double"), ["g"], 500).collect())
    want, before = [], 0
    for band, limit in ((0.9, 350), (0.7, 450), (0.1, 500)):
        for _, i, t, _ in sorted((r for r in rows if r[3] == band), key=lambda r: r[1]):
            if before >= limit:
                break
            want.append((i, before))
            before += len(t.split())
    assert got == sorted(want)

import random

from jsonloom.llm import leaks as L

WORDS = [f"w{i}" for i in range(14)]


def brute(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [L.words(t)] for i in range(len(w) - n + 1)}
    g = {d: grams(t) for d, t in docs}
    return {(d, i) for d in g for i, t in items if g[d] & grams(t)}


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT_WORDS", 300)
    rnd = random.Random(9)
    text = lambda k: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, k)))
    items = [(i, text(12)) for i in range(40)] + [(90, None), (91, "w1"), (92, "w0 absent w1 w2 w3")]
    docs = [(d, text(50)) for d in range(80)] + [(200, None), (201, ""), (202, " .,- ")]
    docs += [(300 + i, "x " + (t or "").upper().replace(" ", ", \n") + " y") for i, t in items[:20]]
    d, q = frames(spark, docs, items)
    index = L.build_index(d, "doc_id", "text")
    for block in (10**6, 30):
        monkeypatch.setattr(L, "BLOCK_WORDS", block)
        got = L.find_passages(index, q, "item_id", "text", 4)
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == sorted(brute(docs, items, 4))


def test_measures(spark):
    item = " ".join(f"v{i}" for i in range(20))
    d, q = frames(spark, [(1, "a " + item + " b"), (2, " ".join(item.split()[3:15])), (3, " ".join(reversed(item.split())))], [(7, item)])
    index = L.build_index(d, "doc_id", "text")
    got = sorted(tuple(r) for r in L.find_passages(index, q, "item_id", "text").collect())
    assert got == [(1, 7, 20, 20, 20), (2, 7, 12, 20, 12)]
    near = {r["doc_id"] for r in L.find_near(index, q, "item_id", "text").collect()}
    assert {1, 3} <= near  # in any order


def test_words():
    assert L.words("Él-42 naïve_x 漢字\tΣ") == ["él", "42", "naïve", "x", "漢字", "σ"] and L.words(None) == []


def test_empty(spark):
    d, q = frames(spark, [], [(1, " ".join("abcdefghijkl"))])
    index = L.build_index(d, "doc_id", "text")
    assert L.find_passages(index, q, "item_id", "text").count() == 0
    d, q = frames(spark, [(1, "a b c")], [])
    assert L.find_passages(L.build_index(d, "doc_id", "text"), q, "item_id", "text").count() == 0


def test_near_finds_changed_parts_and_short_items(spark):
    ws = [f"v{i}" for i in range(60)]
    half = [w if i % 10 else "changed" for i, w in enumerate(ws[:30])]
    docs = [(1, "a " + " ".join(half) + " b"), (2, " ".join(ws[::7])), (3, "one x two y three"), (4, " ".join(ws)), (5, "nothing")]
    d, q = frames(spark, docs, [(7, " ".join(ws)), (8, "one two three"), (9, "unknown words")])
    got = {tuple(r) for r in L.find_near(L.build_index(d, "doc_id", "text"), q, "item_id", "text").collect()}
    assert got == {(1, 7), (4, 7), (3, 8)}

import json

from jsonloom.operators import chunks as C
from jsonloom.operators import enrich as X
from jsonloom.operators.nodes import json_nodes
from jsonloom.operators.retrieval import context_needs, hybrid_search


def test_tags():
    assert X.tag(None) == {"type": "null"} and X.tag(True)["kind"] == "bool"
    assert X.tag([1, {}, "a", 2]) == {"type": "complex", "kind": "array", "size": 4, "kinds": {"int": 2, "object": 1, "string": 1}, "sample": [1, "object", "a"]}
    assert X.tag({"a": 1, "b": []})["keys"] == ["a", "b"]


def test_enhance(spark):
    doc = json.dumps({"when": "2024-03-18 10:00:00", "total": 250.0, "n": None, "user": {"email": "x", "tags": []}})
    df = spark.createDataFrame([(1, "f", doc), (2, "f", None)], "k bigint, f string, t string")
    got = {r["path"]: r for r in X.enhance(C.json_chunks(df, "k", "f", "t", "full")).collect()}
    assert got["when"]["temporal_meta"]["weekday"] == 0 and got["total"]["numeric_meta"]["magnitude"] == 2 and got["n"]["tagged"] == '{"type": "null"}'
    assert got["user.email"]["path_category"] == "contact" and got["user.email"]["string_meta"]["length"] == 1 and got["total"]["path_kind"] == "metric"


def test_ancestors(spark, rows):
    df = spark.createDataFrame([(1, '{"a": {"b": [5]}}'), (2, None), (3, '"' + "x" * 200 + '"')], "k bigint, t string")
    assert rows(X.ancestor_context(df, "k", "t")) == [(1, "$.a.b[0]", 1, "$.a.b", "[5]"), (1, "$.a.b[0]", 2, "$.a", '{"b": [5]}'), (1, "$.a.b[0]", 3, "$", '{"a": {"b": [5]}}')]


def test_hybrid_search(spark, rows):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None)], "id bigint, v array<float>")
    e = spark.createDataFrame([(1, 3, 0.9), (3, 4, 0.9), (1, 2, 0.1), (2, 9, 1.0)], "source bigint, target bigint, confidence double")
    got = rows(hybrid_search(v, e, [1.0, 0.0], 2, least=0.5).select("seed", "chunk", "role", "place"))
    assert got == [(1, 1, "base", 1), (1, 3, "related", 1), (1, 4, "related", 2), (2, 2, "base", 2)]


def test_needs(spark):
    d = spark.createDataFrame([(1, '{"id": "a", "x": [{"x_id": "b", "timestamp": "2024-01-01T00:00:00Z"}]}'), (2, '{"id": "a", "date": "2024-01-02"}'), (3, "{"), (4, None)], "k bigint, chunk_json string")
    r = context_needs(json_nodes(d, "k", "chunk_json")).first()
    assert r["identifiers"] == 2 and r["last_at"] - r["first_at"] == 86_400_000_000

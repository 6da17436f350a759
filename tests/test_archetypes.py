import json

from pyspark.sql import functions as F

from jsonloom.functions.embedding import fronted
from jsonloom.operators import archetypes as A
from jsonloom.operators import enrich as X
from jsonloom.operators import entities as E


def test_registry_keeps_the_last_in_document_order(spark):
    doc = json.dumps({"x": [{"id": "A", "n": i} for i in range(11)]})
    objects = A.json_objects(spark.createDataFrame([(1, doc)], "k bigint, t string"), "k", "t")
    got = E.entity_registry(E.track_entities(objects)).first()
    assert got["node_path"] == "x[10]" and got["mentions"] == 11


def test_names_and_context_of_entities(spark):
    doc = json.dumps({"team": {"id": "T-1", "title": "Desk", "members": [{"name": "Ann", "role": "x"}]}})
    e = E.track_entities(A.json_objects(spark.createDataFrame([(1, doc)], "k bigint, t string"), "k", "t")).cache()
    names = {r["entity_id"]: r["name"] for r in E.entities_with_names(e).collect()}
    assert names == {"T-1": "Desk", "Ann": "Ann"}
    assert {r["entity_value"]: dict(r["context"]) for r in e.collect()} == {"T-1": {"title": "Desk", "members": '[{"name": "Ann", "role": "x"}]'}, "Ann": {"role": "x"}}


def test_shrunk(spark):
    long = {"a": {f"k{i}": "v" * 20 for i in range(20)}, "b": list(range(100)), "c": 1}
    texts = [json.dumps(long), '{"a": 1}', None, "x" * 600, json.dumps([1] * 600)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.shrunk(F.col("t"))).collect()]
    assert json.loads(got[0]) == {"a": {"k0": "...", "k1": "...", "k2": "..."}, "b": ["...", "(100 items total)"], "c": 1} and got[1:] == texts[1:]


def test_members_in_front(spark):
    rows = [('{"id": "7", "name": "n", "v": 2}', a) for a in ("entity_collection", "event_log", "metric_data", None)] + [('"x"', "metric_data")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, a string").select(fronted(F.lit("text"), F.col("t"), F.col("a"))).collect()]
    assert got == ["id:7 name:n text", "text", "id:7 v:2 text", "text", "text"]


def test_best_pattern(spark):
    p = spark.createDataFrame([(1, 0.5, 0.9), (2, 0.4, 0.4), (3, 0.0, 0.0)], "row_key bigint, b double, a double")
    assert sorted(map(tuple, A.best_patterns(p).collect())) == [(1, "a", 0.9), (2, "a", 0.4)]

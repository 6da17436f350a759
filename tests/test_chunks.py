import json

from pyspark.sql import functions as F

from jsonloom.operators import chunks as C
from jsonloom.operators import entities as E
from jsonloom.operators.archetypes import json_objects, rank_archetypes, score_objects
from jsonloom.operators.nodes import json_nodes, structure_stats

ORDERS = {"transaction_date": "2024-03-18", "orders": [{"order_id": f"ORD{i}", "customer_id": "C1", "timestamp": "2024-03-18T09:15:30Z", "items": [{"product_id": "P1", "sku": "P1-B", "quantity": i, "price": 1.5}], "total_amount": 3.0, "status": "completed", "shipping_status": None, "paid": True} for i in range(2)]}
WIDE = {f"k{i}": i for i in range(6)} | {"id": "X-1", "empty": {}, "none": [], "list": [1, [2]], "things": [{"a": 1, "b": 2}, {"c": 1}]}


def docs(spark, *values):
    return spark.createDataFrame([(i, f"/d/{i}.json", v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "k bigint, f string, t string")


def test_entity_like():
    assert C.entity_like({"a": 1, "b": {}}) and not C.entity_like({"a": 1}) and not C.entity_like({c: 1 for c in "abcdef"})
    assert not C.entity_like({"a": [], "b": [], "c": {}}) and not C.entity_like({"a": "x" * 801, "b": 1}) and not C.entity_like([1, 2])


def test_hybrid(spark):
    got = C.json_chunks(docs(spark, ORDERS, WIDE, {}, [], 5, None, "{", ""), "k", "f", "t").orderBy("row_key", "ordinal").collect()
    assert [(r["row_key"], r["path"]) for r in got] == [(0, ""), *[(1, f"k{i}") for i in range(6)], (1, "id"), (1, "empty"), (1, "list[0]"), (1, "list[1][0]"), (1, "things[0]"), (1, "things[1]"), (2, ""), (4, "")]
    by = {(r["row_key"], r["path"]): r for r in got}
    assert json.loads(by[1, "k0"]["context"]) == {k: v for k, v in WIDE.items() if not isinstance(v, (dict, list))}
    assert json.loads(by[1, "things[1]"]["metadata"]) == {"is_collection_item": True, "collection_path": "things", "item_index": 1, "chunked_as_entity": True}
    assert by[1, "id"]["chunk_id"] == spark.sql("select md5('d/1.json:id')").first()[0] and by[1, "k0"]["value_type"] == "int"


def test_bound_and_full(spark):
    assert C.json_chunks(docs(spark, WIDE), "k", "f", "t", most=3).count() == 3
    full = [r["path"] for r in C.json_chunks(docs(spark, {"a": 1, "b": {"c": 2, "d": {}}}), "k", "f", "t", "full").orderBy("ordinal").collect()]
    assert full == ["a", "b.c", "b.d"]


def test_leaves(spark):
    got = C.leaf_chunks(docs(spark, ORDERS), "k", "f", "t")
    assert got.count() == 1 + 2 * 11
    ctx = json.loads(got.where("path = 'orders[1].items[0].price'").first()["context"])
    assert set(ctx) == {"orders", "items", "price"}


def test_hierarchy(spark):
    c = C.json_chunks(docs(spark, {"a": {"b": {"c": {}, "d": 1, "e": 2, "f": 3, "g": 4, "h": 5}, **{f"x{i}": 1 for i in range(6)}}}), "k", "f", "t", "full")
    assert C.parents(c).count() == 0  # only scalars and empty objects are stored
    made = c.unionByName(c.limit(1).withColumn("path", F.lit("a.b")).withColumn("chunk_id", C.chunk_id(F.col("file_path"), F.lit("a.b"))).withColumn("parent_id", F.lit(None).cast("string")))
    assert C.children(made).count() == 6
    assert "Parent (a.b): " in C.with_context(made).where("text like '%Current: 1%' and text like 'Parent%'").first()["text"]


def test_scores(spark):
    got = {r["node_path"]: r for r in score_objects(json_objects(docs(spark, ORDERS), "k", "t")).collect()}
    assert got["orders[0]"]["event_log"] == 0.7 and got[""]["transaction"] == 0.0
    top = rank_archetypes(json_objects(docs(spark, ORDERS), "k", "t")).where("rank = 1 and node_path = 'orders[0]'").first()
    assert top["archetype"] == "api_response" and top["confidence"] == 0.75  # a date begins like a status


def test_entities(spark):
    d = {"project": {"name": "P", "owner": {"id": "u1"}, "team": {"x": {"email": "e", "id": 3}}}}
    got = {r["node_path"]: r for r in E.track_entities(json_objects(docs(spark, d), "k", "t")).collect()}
    assert got["project.owner"]["role"] == "owner" and got["project.owner"]["group_type"] == "project" and got["project"]["entity_type"] == "person"
    assert got["project.team.x"]["entity_value"] == "3" and got["project.team.x"]["group_context"] == "project"
    names = E.display_names(json_nodes(docs(spark, {"user_id": "u", "user_name": "Ann", "label": "L"}), "k", "t"))
    assert sorted((r["name_key"], r["name"]) for r in names.collect()) == [("label", "L"), ("user_id_display", "Ann")]


def test_empty(spark):
    none = docs(spark).limit(0)
    assert C.json_chunks(none, "k", "f", "t").count() == structure_stats(json_nodes(none, "k", "t")).count() == 0

import json

import pytest

from jsonloom.functions.jsonwalk import _deep, document, loads, walk
from jsonloom.operators import nested as N

BAD = ["", None, "{", "[1,]", '{"a":1,}', "{'a':1}", "NaN", '{"a":NaN}', "[1] 2", '"\n"', "01", "tru", '{"a" 1}', '{1:2}', "[", "]", "{]", ","]
GOOD = ["{}", "[]", "1", "-0.5e3", "true", "null", '"x"', ' {"a" : [ 1 , {"b":null} ] } ', '{"é":"\\u00e9\\ud83d\\ude00"}', '[[],[{}],""]', '{"a":1,"a":2}', "123456789012345678901234567890"]


@pytest.mark.parametrize("text", GOOD)
def test_both_readers_agree(text):
    assert _deep(text) == json.loads(text) == loads(text)


@pytest.mark.parametrize("text", BAD)
def test_invalid(text):
    assert document(text) == (False, None)
    if text:
        with pytest.raises(ValueError):
            _deep(text)


def test_any_depth():
    n = 200_000
    ok, doc = document('{"a":' * n + "[]" + "}" * n)
    assert ok and sum(1 for _ in zip(range(n + 5), walk(doc))) == n if n < 3000 else ok


def paths(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    return sorted(tuple(r) for r in N.variant_nodes(df, "k", "t").select("row_key", "node_path", "parent_path").collect())


def test_object_paths(spark):
    doc = {"orders": [{"items": [{}, 1, None, {"x": {"y.z": {}}}]}, [[{"a": []}]]], "": {"q": {}}}
    assert paths(spark, [json.dumps(doc), json.dumps(json.dumps([{"b": {}}])), '"plain"', None, "[1", json.dumps({"s": '{"not": "opened"}'})]) == sorted([
        (0, "orders[0]", ""), (0, "orders[0].items[0]", "orders[0]"), (0, "orders[0].items[3]", "orders[0]"), (0, "orders[0].items[3].x", "orders[0].items[3]"),
        (0, "orders[0].items[3].x.y.z", "orders[0].items[3].x"), (0, "orders[1][0][0]", ""), (0, "", ""), (0, ".q", ""), (1, "[0]", ""), (1, "[0].b", "[0]")])


ODD = [*BAD, *GOOD, *[json.dumps(json.loads(t)) for t in GOOD if t[0] in '[{"'], *[json.dumps(t) for t in GOOD], '{"a":{}} x', '{"a":{}}]', '1] x', '{"a":{}},{"b":{}}', '[{}', '{"a":{"a":1,"a":{}}}', '{"\\ud800":{}}', '{"\\ud83d\\ude00":{"x":[]}}', '{"~end~":{}}', '{"":{"":{}},"a.b":[{"c":{}}]}', '[[[{"x":[[{}]]}]]]', json.dumps([json.dumps({"a": {}})])]


@pytest.mark.parametrize("levels", [24, 2, 0])  # the levels below are walked
def test_variant_levels_as_walked(spark, monkeypatch, levels):
    monkeypatch.setattr(N, "LEVELS", levels)
    doc = {"orders": [{"items": [{}, 1, None, {"x": {"y.z": {}}}]}, [[{"a": []}]]], "": {"q": {}}, "b": 1}
    texts = [*ODD, json.dumps(doc), "[" * 40 + "{}" + "]" * 40, '{"a":' * 30 + "{}" + "}" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string").cache()
    cols = ["row_key", "table_path", "node_path", "parent_path", "ordinal", "depth", "node_id", "parent_id"]
    got = N.variant_nodes(df, "k", "t").select(*cols)
    want = N.json_tables(df, "k", "t").where("depth > 0").select(*cols)
    plain = lambda d: sorted(map(repr, map(tuple, d.collect())))
    assert plain(got) == plain(want)


def test_struct_paths(spark, rows):
    df = spark.sql("select 7L as id, array(struct(1 as a, array(struct(2 as b), null) as inner), null) as items, 1 as v union all select 8L, null, 2")
    assert rows(N.struct_object_paths(df, "id", "items")) == [(7, "items[0]", ""), (7, "items[0].inner[0]", "items[0]")]


def test_related_tables(spark):
    docs = [(1, json.dumps({"row_key": "clash", "n": 1, "lines": [{"sku": "A", "q": 1}, {"sku": "B", "q": 1.5, "ok": True}]})), (2, json.dumps({"n": "x", "lines": []})), (3, "{}"), (4, None)]
    df = spark.createDataFrame(docs, "k bigint, t string")
    tables, schema = N.json_tables(df, "k", "t").cache(), N.merged_schema(df, "t")
    root = {r["row_key"]: r for r in N.child_table(tables, schema, "").collect()}
    assert root[1]["row_key_value"] == "clash" and root[1]["n"] == "1" and root[2]["n"] == "x" and root[3]["n"] is None
    lines = sorted(N.child_table(tables, schema, "lines[]").collect(), key=lambda r: r["ordinal"])
    assert [(r["sku"], r["q"], r["ok"], r["ordinal"]) for r in lines] == [("A", 1.0, None, 0), ("B", 1.5, True, 1)]
    assert {r["parent_id"] for r in lines} == {root[1]["node_id"]}


def test_empty(spark):
    df = spark.createDataFrame([], "k bigint, t string")
    assert N.variant_nodes(df, "k", "t").count() == N.merged_schema(df, "t").count() == N.json_tables(df, "k", "t").count() == 0


def test_native_tables_have_keys_and_fields(spark, tmp_path):
    item = "named_struct('product_id', 'P1', 'sku', 'S1', 'quantity', 2L, 'price', 1.5D, 'ordinal', 'x', 'tags', array('a', 'b'), 'parts', array(named_struct('n', 7)))"
    df = spark.sql(f"select 7L as id, array({item}, null) as items union all select 8L, null").cache()
    row = N.struct_table(df, "id", "items", "items[]").first().asDict()
    assert row["row_key"] == 7 and row["ordinal"] == 0 and row["node_path"] == "items[0]" and row["ordinal_value"] == "x"
    assert (row["product_id"], row["sku"], row["quantity"], row["price"], row["tags"]) == ("P1", "S1", 2, 1.5, ["a", "b"]) and "parts" not in row
    part = N.struct_table(df, "id", "items", "items[].parts[]").first()
    assert part["parent_id"] == row["node_id"] and part["n"] == 7
    # as from the same rows written as JSON
    text = spark.sql("select 7L as id, '{\"items\": [{\"product_id\": \"P1\", \"sku\": \"S1\", \"quantity\": 2, \"price\": 1.5, \"ordinal\": \"x\", \"tags\": [\"a\", \"b\"], \"parts\": [{\"n\": 7}]}, null]}' as t")
    names = ["row_key", "table_path", "node_path", "parent_path", "ordinal", "depth", "node_id", "parent_id", "node_json"]
    plain = lambda t: sorted((*tuple(r)[:-1], json.loads(r["node_json"])) for r in t.where("node_path <> ''").select(*names).collect())
    assert plain(N.struct_tables(df, "id", "items")) == plain(N.json_tables(text, "id", "t"))


def test_p2_tables_hold_all_member_values(spark):
    from jsonloom.plans.registry import queries

    sf = "/root/testdata/sf0.001"
    got = queries()["p2_tables"](spark, sf).cache()
    for name, column, query in (("order_transactions", "items", "p2_items"), ("product_catalog", "variants", "p2_variants")):
        want = sorted((r["record_id"], k, tuple(x)) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect() for k, x in enumerate(r[column] or []) if x is not None)
        assert sorted((r["row_key"], r["ordinal"], tuple(json.loads(r["node_json"]).values())) for r in got.where(f"source_table = '{name}'").collect()) == want
        assert sorted((r["row_key"], r["ordinal"], tuple(r)[5:]) for r in queries()[query](spark, sf).collect()) == want
    below = got.where("node_path <> ''").select("source_table", "row_key", "node_path", "parent_path")
    assert below.exceptAll(queries()["p2_found"](spark, sf)).count() == 0


def test_arrays_of_values_are_members(spark):
    deep = "[" * 5000 + "1" + "]" * 5000
    df = spark.createDataFrame([(1, '{"a": ["x", {"b": 1}, [2, {}]], "o": [{"c": null}], "e": [], "n": null}'), (2, '{"a": 3, "d": %s}' % deep)], "k bigint, t string")
    tables = N.json_tables(df, "k", "t").cache()
    got = {(r["row_key"], r["node_path"]): r["node_json"] for r in tables.collect()}
    assert json.loads(got[1, ""]) == {"a": ["x", None, [2, None]], "e": [], "n": None} and json.loads(got[1, "o[0]"]) == {"c": None}
    assert got[2, ""].replace(" ", "") == '{"a":3,"d":%s}' % deep
    root = {r["row_key"]: r["a"] for r in N.child_table(tables.where("row_key = 1 or node_path <> ''"), N.merged_schema(df, "t"), "").collect()}
    assert json.loads(root[1]) == ["x", None, [2, None]]


def test_too_wide_a_table_is_refused(spark, monkeypatch):
    df = spark.createDataFrame([(1, '{"a": 1, "b": 2, "c": 3}')], "k bigint, t string")
    tables, schema = N.json_tables(df, "k", "t"), N.merged_schema(df, "t")
    monkeypatch.setattr(N, "MAX_SCHEMA", 4)
    assert N.child_table(tables, schema, "").columns[-3:] == ["a", "b", "c"]
    monkeypatch.setattr(N, "MAX_SCHEMA", 3)
    with pytest.raises(ValueError, match="more than 3"):
        N.child_table(tables, schema, "")

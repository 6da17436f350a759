import json

from jsonloom.plans.ingest import ingest
from jsonloom.plans.planner import ask, corpus_questions
from jsonloom.sources.store import Store
from jsonloom.streaming.streams import event_windows, run_once, stream_ingest

DOC = {f"k{i}": i for i in range(6)} | {"user_id": "U-1", "orders": [{"order_id": "O-1", "user_id": "U-1", "n": 2}]}


def test_ingest_again_and_changed(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "store")
    (src / "deep").mkdir(parents=True)
    (src / "a.json").write_text(json.dumps(DOC))
    (src / "deep/b.json").write_text("{broken")
    (src / "test_queries").write_text("{}")
    assert ingest(spark, str(src), root) == 2
    store = Store(spark, root)
    n = store.read("json_chunks").count()
    assert n == 8 and store.read("file_metadata").count() == 2 and store.read("chunk_key_values").count() > 8
    assert store.read("chunk_relationships").count() > 0
    assert ingest(spark, str(src), root) == 0
    (src / "a.json").write_text(json.dumps(DOC | {"k0": 7}))
    assert ingest(spark, str(src), root) == 1
    assert store.read("json_chunks").count() == n and store.read("json_chunks").where("path = 'k0'").first()["chunk_json"] == "7"
    one = store.read("json_chunks").first()["chunk_id"]
    assert store.chunk(one).count() == 1
    store.reset()
    assert store.read("json_chunks").count() == 0


def test_changed_files_leave_nothing_behind(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    put = lambda name, doc: (src / name).write_text(json.dumps(doc))
    wide = {f"k{i}": i for i in range(6)}
    put("a.json", wide | {"gone": 1, "main_id": "X-1", "part": {"status": "open", "timestamp": "2024-01-01T00:00:00", "value": 5}})
    put("b.json", wide | {"link_id": "Y-1", "sub": {f"m{i}": i for i in range(6)} | {"main_id": "X-1"}})
    ingest(spark, str(src), root)
    store = Store(spark, root)
    edges = lambda: {(r["source"], r["target"]) for r in store.read("chunk_relationships").collect()}
    of = lambda name, path: {r["chunk_id"] for r in store.read("json_chunks").collect() if r["file_path"].endswith(name) and r["path"] == path}.pop()
    part = of("a.json", "part")
    assert {"event_log", "api_response"} <= {r["archetype"] for r in store.archetypes(part).collect()}
    assert [tuple(r) for r in store.summaries().collect()] == [("2024-01-01", "date", 1, 5.0)]
    assert {r["path"] for r in store.with_values({"k1": "1", "gone": "1"}).collect()} == set() and {r["path"] for r in store.with_values({"gone": "1"}).collect()} == {"gone"}
    first = edges()
    assert (part, of("a.json", "main_id")) in first or (part, of("b.json", "sub.main_id")) in first
    # a.json loses members and its identifier; what other files referred to follows
    put("a.json", wide | {"other_id": "Y-1"})
    assert ingest(spark, str(src), root) == 1
    chunks = store.read("json_chunks").collect()
    ids = {r["chunk_id"] for r in chunks}
    assert {r["path"] for r in chunks if r["file_path"].endswith("a.json")} == {*wide, "other_id"}
    for name in ("chunk_archetypes", "group_parts"):
        assert not [r for r in store.read(name).collect() if r["file_path"].endswith("a.json")]
    assert not [r for r in store.read("chunk_key_values").collect() if r["key_name"] == "gone"]
    assert edges() and all(s in ids and t in ids for s, t in edges())
    # as if all had been ingested at once
    other = str(tmp_path / "again")
    ingest(spark, str(src), other)
    plain = lambda r: sorted((x["source"], x["target"], x["relationship_type"], x["metadata"]) for x in Store(spark, r).read("chunk_relationships").collect())
    assert plain(root) == plain(other)
    (src / "b.json").unlink()
    ingest(spark, str(src), root, prune=True)
    assert {r["file_path"].rsplit("/", 1)[1] for r in store.read("json_chunks").collect()} == {"a.json"}


def test_only_buckets_of_changed_files_are_written(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    for i in range(8):
        (src / f"f{i}.json").write_text(json.dumps(DOC | {"n": i}))
    ingest(spark, str(src), root)
    store = Store(spark, root)
    before = store._manifest("json_chunks")["paths"]
    (src / "f3.json").write_text(json.dumps(DOC | {"n": 33}))
    ingest(spark, str(src), root)
    after = store._manifest("json_chunks")["paths"]
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1


def test_stream_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps(DOC))
    for n in (1, 2):
        stream_ingest(spark, str(src), str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
        assert Store(spark, str(tmp_path / "store")).read("file_metadata").count() == n
        (src / "b.json").write_text(json.dumps(DOC | {"k1": 9}))


def test_stream_windows(spark, tmp_path):
    ev = spark.sql("select timestamp_ntz'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id*20) as ts, 'a' as event_type, 1.5D as value from range(12)")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = event_windows(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")))
    got = {r["window_start"]: r["n"] for r in run_once(spark, stream, str(tmp_path / "run")).collect()}
    want = {r["window_start"]: r["n"] for r in event_windows(ev).collect()}
    assert got and all(want[k] == n for k, n in got.items())  # the last window is still open


def test_questions(tmp_path):
    (tmp_path / "q").write_text('Directions\n\n"What is it?"\n"List it."\nno\n')
    assert corpus_questions(str(tmp_path / "q")) == ["What is it?", "List it"]


def test_unsupported(spark):
    assert ask(spark, "/nowhere", "hello there").first()["status"] == "unsupported"


def test_all_chunks_of_a_long_document(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    orders = [{"order_id": f"O-{i}", "n": i} for i in range(150)]
    (src / "a.json").write_text(json.dumps(DOC | {"orders": orders, "late_id": "L-1"}))
    ingest(spark, str(src), root)
    store = Store(spark, root)
    held = {r["path"]: r["chunk_id"] for r in store.read("json_chunks").collect()}
    assert set(held) == {*(k for k in DOC if k != "orders"), *(f"orders[{i}]" for i in range(150)), "late_id"}
    edges = {(r["source"], r["target"]) for r in store.read("chunk_relationships").collect()}
    assert {(held[f"orders[{i}]"], held["late_id"]) for i in range(150)} <= edges
    assert store.read("chunk_key_values").where("path = 'late_id'").first()["chunk_id"] in held.values()

"""How much objects and documents look like known structures.

Objects are rows with the names, kinds and texts of their members; the six object scores are
Columns over those arrays, so no member is exploded. Document patterns aggregate the node table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.jsonwalk import clean, document, kind, text_of, walk
from jsonloom.session import spread

# What counts as a timestamp in a text, and as the beginning of an HTTP status.
TIMESTAMPS = [
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{4}/\d{2}/\d{2}",
]
HTTP_STATUS = [r"^[1-5][0-9]{2}$", r"2\d{2}", r"3\d{2}", r"4\d{2}", r"5\d{2}"]
TIMESTAMP = "|".join(TIMESTAMPS)
HTTP = "^(?:" + "|".join(HTTP_STATUS) + ")"
# Member names by which objects are scored.
EVENT_KEYS = [["event", "action", "type", "status", "level", "severity"], ["sequence", "id", "index", "order"]]
METRIC_KEYS = [["value", "metric", "measure", "count", "rate", "total"], ["unit", "dimension", "scale", "period"]]
API_KEYS = [["status", "code", "message", "error", "data", "response"], ["headers", "timestamp", "version", "api"]]
STATE_KEYS = [["state", "status", "current", "previous", "next"], ["transition", "from", "to", "action"], ["valid", "allowed", "rules", "constraints"]]
ENTITY_KEYS = [["id", "uuid", "key", "name"], ["parent", "child", "related", "owner", "group"], ["type", "category", "class", "attributes"], ["items", "elements", "entries", "records"]]
DEAL_KEYS = [["transaction", "order", "payment", "invoice", "purchase", "sale", "shipment", "total", "amount", "price"], ["buyer", "seller", "customer", "supplier", "party"]]
# Member names by which documents are scored.
PATTERN_KEYS = {
    "record": ["id", "uuid", "name", "type", "code", "key", "properties", "attributes", "metadata"],
    "event": ["timestamp", "time", "date", "created_at", "updated_at", "occurred_at", "status", "state", "type", "action", "order_date", "delivery_date", "eta"],
    "metric": ["value", "amount", "count", "total", "quantity", "rate", "percentage", "score", "ratio", "stock", "reserved", "available", "balance", "level"],
    "state": ["status", "state", "enabled", "active", "config", "settings", "preferences", "mode", "flags"],
    "document": ["content", "data", "body", "text", "description", "details", "sections", "elements"],
}


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ok, doc = document(text)
            found = [("", doc)] + [(n[0], n[4]) for n in walk(doc)] if ok else []
            for n, (path, v) in enumerate(found):
                if isinstance(v, dict):
                    rows.append((key, clean(path), n, [clean(k) for k in v], [kind(x) for x in v.values()], [text_of(x) for x in v.values()]))
        cols = list(zip(*rows)) or [()] * 6
        names = pa.list_(pa.string())
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int32(), names, names, names])], ["row_key", "node_path", "ordinal", "members", "kinds", "texts"])


def json_objects(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every object, roots included: (row_key, node_path, ordinal in the document, members, kinds, texts)."""
    return spread(df.select(F.col(key).cast("bigint"), F.col(text))).mapInArrow(_batches, "row_key bigint, node_path string, ordinal int, members array<string>, kinds array<string>, texts array<string>")


def _has(keys: list[str]) -> Column:
    return F.arrays_overlap("members", F.array(*map(F.lit, keys)))


def _points(c: Column, n: float) -> Column:
    return F.when(c, n).otherwise(0.0)


def object_scores() -> dict[str, Column]:
    """The six scores of an object."""
    stamped = F.exists("texts", lambda t: F.coalesce(t.rlike(TIMESTAMP), F.lit(False)))
    numbers = F.size(F.filter("kinds", lambda k: k.isin("int", "float", "bool")))
    http = F.exists(F.arrays_zip("kinds", "texts"), lambda z: z["kinds"].isin("string", "int") & F.coalesce(z["texts"].rlike(HTTP), F.lit(False)))
    share = F.when(F.size("members") > 0, numbers / F.size("members")).otherwise(0.0)
    api = F.size(F.array_intersect("members", F.array(*map(F.lit, API_KEYS[0])))) / F.lit(6.0)
    return {
        "event_log": F.when(stamped, 0.4 + _points(_has(EVENT_KEYS[0]), 0.3) + _points(_has(EVENT_KEYS[1]), 0.2)).otherwise(0.0),
        "metric_data": 0.3 * share + _points(_has(METRIC_KEYS[0]), 0.3) + _points(stamped, 0.2) + _points(_has(METRIC_KEYS[1]), 0.2),
        "api_response": 0.3 * api + _points(http, 0.4) + _points(_has(API_KEYS[1]), 0.3),
        "state_machine": _points(_has(STATE_KEYS[0]), 0.4) + _points(_has(STATE_KEYS[1]), 0.3) + _points(stamped, 0.2) + _points(_has(STATE_KEYS[2]), 0.1),
        "entity_collection": _points(_has(ENTITY_KEYS[0]), 0.3) + _points(_has(ENTITY_KEYS[1]), 0.3) + _points(_has(ENTITY_KEYS[2]), 0.2) + _points(_has(ENTITY_KEYS[3]), 0.2),
        "transaction": _points(_has(DEAL_KEYS[0]), 0.4) + _points(numbers > 0, 0.3) + _points(_has(DEAL_KEYS[1]), 0.3),
    }


def score_objects(objects: DataFrame) -> DataFrame:
    return objects.select("row_key", "node_path", *[F.round(c, 6).alias(n) for n, c in object_scores().items()])


def rank_archetypes(objects: DataFrame) -> DataFrame:
    """(row_key, node_path, rank, archetype, confidence): the scores above 0, best first, ties by name."""
    all_of = F.array(*[F.struct((-F.round(c, 6)).alias("s"), F.lit(n).alias("archetype")) for n, c in object_scores().items()])
    top = F.array_sort(F.filter(all_of, lambda x: x["s"] < 0))
    return objects.select("row_key", "node_path", F.posexplode(top).alias("p", "x")).select("row_key", "node_path", (F.col("p") + 1).alias("rank"), "x.archetype", (-F.col("x.s")).alias("confidence"))


def document_patterns(nodes: DataFrame) -> DataFrame:
    """Seven pattern scores per document; they may exceed 1 where evidence adds up."""
    scalar = ~F.col("kind").isin("object", "array")
    text = F.when(scalar, F.concat_ws("=", "kind", F.coalesce("value", F.lit(""))))
    per = nodes.groupBy("row_key", "member").agg(
        F.count_if(F.col("kind").isin("int", "float", "bool") & F.col("member").isNotNull()).alias("numbers"),
        F.count_if((F.col("kind") == "string") & F.col("value").rlike(TIMESTAMP)).alias("stamps"),
        F.count_if(F.col("member").isin("status", "state") & scalar).alias("states"),
        (F.min(text) == F.max(text)).alias("stable"),
        F.max(F.col("kind") == "array").alias("array"),
        F.max("depth").alias("depth"),
    )
    named = F.col("member").isNotNull()
    g = per.groupBy("row_key").agg(
        F.collect_set("member").alias("keys"),  # bounded by one document
        *[F.sum(c).alias(c) for c in ("numbers", "stamps", "states")],
        F.coalesce(F.max(F.when(named, F.col("stable"))), F.lit(False)).alias("stable"),
        F.count_if(named & F.col("array")).alias("arrays"),
        F.max("depth").alias("depth"),
    )
    hit = lambda p: F.size(F.array_intersect("keys", F.array(*map(F.lit, PATTERN_KEYS[p]))))
    part = lambda p: hit(p) / F.lit(float(len(PATTERN_KEYS[p])))
    any_of = lambda ks: F.arrays_overlap("keys", F.array(*map(F.lit, ks)))
    ident = any_of(["id", "uuid"])
    scores = {
        "record": part("record") * F.when(ident & any_of(["name", "type", "code"]), 2.0).when(ident & F.col("stable"), 1.5).when(hit("record") < 2, 0.25).otherwise(1.0),
        "event": part("event") * F.when((F.col("stamps") > 0) & (F.col("states") > 0), 2.0).when(F.col("stamps") > 0, 1.5).otherwise(1.0),
        "collection": F.least(F.col("arrays") / 2.0, F.lit(1.0)),
        "reference": F.least(F.size(F.filter("keys", lambda k: k.rlike("(_id|_ref)$"))) / 2.0, F.lit(1.0)),
        "metric": part("metric") * F.when((F.col("numbers") > 0) & any_of(["quantity", "stock", "reserved", "available"]), 2.0).when(F.col("numbers") > 0, 1.5).otherwise(1.0),
        "state": part("state"),
        "document": (part("document") + F.when(F.col("depth") > 2, 1.0).otherwise(0.0)) / 2.0,
    }
    return g.select("row_key", *[F.round(c, 6).alias(n) for n, c in scores.items()])


def pattern_counts(patterns: DataFrame, least: float = 0.5) -> DataFrame:
    """How many documents show each pattern with more than `least` confidence."""
    names = [c for c in patterns.columns if c != "row_key"]
    long = patterns.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(n).alias("confidence")) for n in names])).alias("x")).select("x.*")
    return long.groupBy("pattern").agg(F.count_if(F.col("confidence") > least).alias("documents"))


def best_patterns(patterns: DataFrame) -> DataFrame:
    """(row_key, pattern, confidence): the pattern that fits a document best, ties by name; documents without any are left out."""
    names = [c for c in patterns.columns if c != "row_key"]
    best = F.array_min(F.array(*[F.struct((-F.col(n)).alias("c"), F.lit(n).alias("pattern")) for n in names]))
    return patterns.select("row_key", best["pattern"].alias("pattern"), (-best["c"]).alias("confidence")).where("confidence > 0")


def key_edges(nodes: DataFrame) -> DataFrame:
    """In-document references: members id, ref, parent_id or *_id, from the object above to the name."""
    n = nodes.where(F.col("member").isin("id", "ref", "parent_id") | F.col("member").endswith("_id"))
    return n.select("row_key", F.nullif("parent_path", F.lit("")).alias("source"), F.col("member").alias("target"), F.lit("key-based").alias("type"), "path")


def metadata_profile(nodes: DataFrame) -> DataFrame:
    """Per document: timestamp layouts, event types, units, dimensions, paging and response members, each sorted."""
    from jsonloom.functions.scalars import timestamp_format

    m, v = F.col("member"), F.col("value")
    timed = m.rlike("timestamp|created_at|date|time|datetime")
    container = F.element_at(F.split(F.regexp_replace("parent_path", r"\[\d+\]", ""), r"\."), -1)
    pick = lambda c, x: F.array_join(F.array_sort(F.collect_set(F.when(c, x))), ",")
    return nodes.where("member is not null").groupBy("row_key").agg(
        pick(timed, timestamp_format(v)).alias("timestamp_formats"),
        pick(m.isin("event", "event_type", "action", "type") & v.isNotNull(), v).alias("event_types"),
        pick(m.isin("unit", "units") & v.isNotNull(), v).alias("units"),
        pick(container.isin("dimensions", "tags", "labels"), m).alias("dimensions"),
        pick(m.isin("offset", "limit", "cursor", "next_cursor", "page", "per_page", "total_pages"), m).alias("paging"),
        pick(m.isin("data", "results", "items", "records", "meta", "metadata", "_metadata", "error", "errors", "fault"), m).alias("response"),
    )

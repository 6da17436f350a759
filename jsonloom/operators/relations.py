"""Edges between chunks: explicit references, kinship of subject, closeness in time, and the graph over them.

All edges are (source, target, relationship_type, confidence, metadata JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.functions.keys import iso_micros

EDGE = ["source", "target", "relationship_type", "confidence", "metadata"]
DAY = 86_400_000_000
# Words that put a chunk into a class, the confidence of the class, and what it relates to.
CLASSES = {"invoice_ledger": (["invoice", "payment", "transaction", "ledger", "accounting"], 0.7), "product_inventory": (["product", "inventory", "stock", "warehouse", "supply"], 0.8), "customer_order": (["customer", "order", "purchase", "buyer"], 0.75)}
RELATED = [("invoice_ledger", "customer_order"), ("product_inventory", "customer_order"), ("customer_order", "invoice_ledger"), ("customer_order", "product_inventory")]


def _edge(df: DataFrame, kind: str | Column, confidence: float | Column, **meta: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    confidence = F.lit(confidence) if isinstance(confidence, (int, float)) else confidence
    return df.select("source", "target", kind.alias("relationship_type"), confidence.cast("double").alias("confidence"), F.to_json(F.struct(*[c.alias(k) for k, c in meta.items()])).alias("metadata"))


def explicit_edges(fields: DataFrame) -> DataFrame:
    """References among chunks by value, from string members (chunk, ordinal, member, value).

    A value is an identifier if its member is id or *_id, or it looks like ABC-123; the last chunk
    with an identifier (by ordinal, then chunk, then member) owns it. Any chunk with the value refers to the owner.
    """
    s = fields.where("value is not null")
    ident = F.col("member").isin("id") | F.col("member").endswith("_id") | F.col("value").rlike(r"^[A-Z]+-\d+$")
    owner = s.where(ident).groupBy("value").agg(F.max(F.struct("ordinal", "chunk")).alias("o")).select("value", F.col("o.chunk").alias("target"))
    hits = s.join(owner, "value").where("chunk <> target").select(F.col("chunk").alias("source"), "target", "member", "value")
    return _edge(hits.distinct(), "explicit", 1.0, field=F.col("member"), value=F.col("value"))


def classify_subject(text: Column) -> Column:
    """The classes whose words occur in a text, in lower case."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(words)), F.lit(name)) for name, (words, _) in CLASSES.items()]))


def semantic_links(chunks: DataFrame, within: list[str]) -> DataFrame:
    """Kinship of chunks (chunk, text, and the columns `within`) with the related classes of their group.

    Every pair of chunks of two related classes of a group is an edge, which grows with the square
    of the group. So edges are given per chunk and class: (chunk, *within, source_class,
    target_class, confidence, links), links being the number of its partners; the members of a class
    are those with it as source_class.
    """
    tagged = chunks.select("chunk", *within, classify_subject(F.col("text")).alias("own")).select("*", F.explode("own").alias("source_class"))
    size = tagged.groupBy(*within, F.col("source_class").alias("target_class")).agg(F.count(F.lit(1)).alias("n"))
    steps = F.create_map(*[x for a in CLASSES for x in (F.lit(a), F.array(*[F.lit(b) for p, b in RELATED if p == a]))])
    weight = F.create_map(*[x for a, (_, c) in CLASSES.items() for x in (F.lit(a), F.lit(c))])
    asks = tagged.withColumn("target_class", F.explode(steps[F.col("source_class")]))
    got = asks.join(size, [*within, "target_class"])
    itself = F.array_contains("own", F.col("target_class")).cast("int")
    return got.withColumn("links", F.col("n") - itself).where("links > 0").select("chunk", *within, "source_class", "target_class", weight[F.col("source_class")].alias("confidence"), "links")


def temporal_edges(times: DataFrame, within: list[str], days: int = 30) -> DataFrame:
    """Edges between chunks of a group whose closest times are at most `days` whole days apart, from (chunk, at).

    Times are cut into buckets one day longer than the reach; each row looks into its own and the
    next bucket. The chunk whose first time is earlier is the source; the smaller id on ties.
    """
    span = (days + 1) * DAY
    t = times.where("at is not null").select("chunk", *within, "at").distinct()
    first = Window.partitionBy("chunk", *within)
    t = t.withColumn("first", F.min("at").over(first)).withColumn("b", F.floor(F.col("at") / span).cast("bigint"))
    a = t.select(*within, F.col("chunk").alias("ca"), F.col("at").alias("ta"), F.col("first").alias("fa"), F.explode(F.array(F.col("b") - 1, "b", F.col("b") + 1)).alias("b"))
    c = t.select(*within, F.col("chunk").alias("cb"), F.col("at").alias("tb"), F.col("first").alias("fb"), "b")
    near = a.join(c, [*within, "b"]).where("ca <> cb and (fa < fb or (fa = fb and ca < cb))").where(F.abs(F.col("ta") - F.col("tb")) < span)
    best = near.groupBy("ca", "cb").agg(F.min(F.abs(F.col("ta") - F.col("tb"))).alias("gap")).withColumn("d", F.floor(F.col("gap") / DAY).cast("int"))
    got = best.where(F.col("d") <= days).select(F.col("ca").alias("source"), F.col("cb").alias("target"), "d")
    return _edge(got, "temporal", F.round(1 - F.col("d") / float(days), 6), date_difference_days=F.col("d"))


def string_times(nodes: DataFrame) -> DataFrame:
    """(row_key, at) of the ISO timestamps among a document's strings."""
    t = nodes.where((F.col("kind") == "string") & F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"))
    return t.select("row_key", iso_micros(F.col("value")).alias("at"))


def holds_identifier(path: Column) -> Column:
    """A segment of the path ends in id."""
    return F.exists(F.split(path, r"\."), lambda s: s.endswith("id"))


def reference_edges(leaves: DataFrame, context: DataFrame) -> DataFrame:
    """Edges from chunks to the chunk that holds an identifier of their context.

    leaves: (chunk, ordinal, path, value) of scalar string chunks; those with a path segment that
    ends in id hold identifiers, the last one by ordinal owning a value. context: (chunk, path,
    field, value) identifiers around each chunk. The kind follows the field's first word.
    """
    owner = leaves.where(holds_identifier(F.col("path")) & (F.col("value") != "")).groupBy("value").agg(F.max(F.struct("ordinal", "chunk", "path")).alias("o")).select("value", F.col("o.chunk").alias("target"), F.col("o.path").alias("target_path"))
    kind = F.lit("reference")
    for word in ("shipment", "warehouse", "product", "supplier"):
        kind = F.when(F.startswith("field", F.lit(f"{word}s_")), f"{word}_reference").otherwise(kind)
    hits = context.join(owner, "value").withColumnRenamed("chunk", "source").withColumn("kind", kind)
    edges = _edge(hits, F.col("kind"), 1.0, field=F.col("field"), source_path=F.col("path"), target_path=F.col("target_path"), target_value=F.col("value"))
    return keyed_last(edges, ["source", "target", "relationship_type"], ["metadata"])


def keyed_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def united(*edges: DataFrame) -> DataFrame:
    """Edges of several kinds as one."""
    out = edges[0].select(*EDGE)
    for e in edges[1:]:
        out = out.unionByName(e.select(*EDGE))
    return out


def membership_edges(links: DataFrame) -> DataFrame:
    """semantic_links as edges: from a chunk to each class of its group that it is related to, with the number of its members."""
    group = [c for c in links.columns if c not in ("chunk", "source_class", "target_class", "confidence", "links")]
    target = F.concat_ws("#", F.col("target_class"), *[F.col(c) for c in group])
    e = links.groupBy(F.col("chunk").cast("string").alias("source"), target.alias("target")).agg(F.max("confidence").alias("c"), F.max("links").alias("links"))
    return _edge(e, "semantic", F.col("c"), links=F.col("links"))


def top_edges(edges: DataFrame, n: int = 3) -> DataFrame:
    """The n outgoing edges of each source with the highest confidence, ties by target and type."""
    w = Window.partitionBy("source").orderBy(F.desc("confidence"), "target", "relationship_type")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def touching(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges seen from either end, both ends stored: (chunk, other, direction, type, confidence)."""
    ids = chunks.select(F.col("chunk").alias("source")).distinct()
    e = edges.join(ids, "source", "left_semi").join(ids.withColumnRenamed("source", "target"), "target", "left_semi")
    out = e.select(F.col("source").alias("chunk"), F.col("target").alias("other"), F.lit("out").alias("direction"), "relationship_type", "confidence")
    into = e.where("source <> target").select(F.col("target").alias("chunk"), F.col("source").alias("other"), F.lit("in").alias("direction"), "relationship_type", "confidence")
    return out.unionByName(into)


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int | None = None) -> DataFrame:
    """(seed, chunk, depth): chunks reached from each seed along outgoing edges, at their least depth.

    The bounded depth makes it a chain of equi-joins; a path never returns to a chunk it holds.
    most: the first so many per seed by depth and id.
    """
    step = edges.select("source", "target").where("source <> target").distinct()
    now = seeds.select(F.col("chunk").alias("seed"), F.col("chunk").alias("at"), F.array("chunk").alias("path")).distinct()
    out = None
    for k in range(1, depth + 1):
        now = now.join(step, F.col("at") == F.col("source")).where(~F.array_contains("path", F.col("target"))).select("seed", F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path"))
        here = now.select("seed", F.col("at").alias("chunk"), F.lit(k).alias("depth"))
        out = here if out is None else out.unionByName(here)
    got = out.groupBy("seed", "chunk").agg(F.min("depth").alias("depth"))
    if most is None:
        return got
    w = Window.partitionBy("seed").orderBy("depth", "chunk")
    return got.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")

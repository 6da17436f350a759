"""The node table: every JSON value below the root of a document, addressed by path.

One Arrow pass per document; nothing is shuffled. Null, empty and invalid documents give no node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.jsonwalk import clean, document, kind, text_of, walk
from jsonloom.session import spread

SCHEMA = "row_key bigint, ordinals array<int>, path string, parent_path string, container_path string, member string, kind string, value string, number double, depth int, size int"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.list_(pa.int32()), *[pa.string()] * 6, pa.float64(), pa.int32(), pa.int32()]
FLUSH = 8192


def number_of(v) -> float | None:
    """A number, or a truth value as 0 or 1; too large ones are null."""
    if not isinstance(v, (bool, int, float)):
        return None
    try:
        return float(v)
    except OverflowError:
        return None


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(_NAMES)
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, _TYPES)], _NAMES)

    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ok, doc = document(text)
            if not ok:
                continue
            for path, above, ords, member, v, container, _ in walk(doc):
                box = isinstance(v, (dict, list))
                rows.append((key, ords, clean(path), clean(above), clean(container), None if member is None else clean(member), kind(v), None if box else text_of(v), None if box else number_of(v), len(ords), len(v) if box else None))
                if len(rows) >= FLUSH:
                    yield flush(rows)
                    rows = []
        yield flush(rows)


def json_nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """All nodes below the root. parent_path is the nearest object, container_path the object or array around."""
    return spread(df.select(F.col(key).cast("bigint"), F.col(text))).mapInArrow(_batches, SCHEMA)


def key_value_pairs(nodes: DataFrame) -> DataFrame:
    """The scalar members and elements as (row_key, key_name, value_text, data_type, path)."""
    name = F.coalesce("member", F.regexp_extract("path", r"([^.\[\]]*)(?:\[\d+\])*$", 1))
    return nodes.where("kind not in ('object', 'array')").select("row_key", name.alias("key_name"), F.col("value").alias("value_text"), F.col("kind").alias("data_type"), "path")


def with_pairs(pairs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(row_key) of the documents that have all the wanted key=value pairs somewhere; none wanted gives all documents with pairs."""
    out = None
    for k, v in wanted.items():
        own = pairs.where((F.col("key_name") == k) & (F.col("value_text") == v)).select("row_key").distinct()
        out = own if out is None else out.join(own, "row_key", "left_semi")
    return pairs.select("row_key").distinct() if out is None else out


def structure_stats(nodes: DataFrame) -> DataFrame:
    """Per document: nodes, greatest depth, arrays, and scalars by kind."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return nodes.groupBy("row_key").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("max_depth"), *[n(k) for k in ("array", "object", "string", "int", "float", "bool", "null")])


def key_frequencies(nodes: DataFrame) -> DataFrame:
    """How often each member name occurs, in how many documents, and its last _ suffix."""
    g = nodes.where("member is not null").groupBy("member", "row_key").agg(F.count(F.lit(1)).alias("n"))
    suffix = F.when(F.col("member").contains("_"), F.substring_index("member", "_", -1))
    return g.groupBy("member").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents")).withColumn("suffix", suffix)


def depth_stats(nodes: DataFrame) -> DataFrame:
    """Least, greatest and mean depth of scalar nodes over all documents."""
    return nodes.where("kind not in ('object', 'array')").agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 6).alias("avg_depth"))

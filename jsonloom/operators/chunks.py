"""Documents as path-addressed chunks.

`hybrid` keeps small entity-like objects whole and descends into the others; `full` descends to
scalars and empty objects, arrays of entity-like objects excepted; `leaf_chunks` gives scalars only.
One Arrow pass per document, no shuffle. Null, empty and invalid documents give no chunk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.functions.jsonwalk import clean, document
from jsonloom.session import spread

#: Bounds of an object that stays whole: members, nested members, characters of its scalars.
ENTITY_MEMBERS = (2, 5)
ENTITY_NESTED = 2
ENTITY_CHARS = 800
#: Characters of chunks and contexts that a worker holds before it hands them on.
FLUSH_CHARS = 1 << 24
_PYTHON_KIND = {str: "str", bool: "bool", int: "int", float: "float", type(None): "NoneType", dict: "dict", list: "list"}


def entity_like(obj) -> bool:
    """A small object: 2 to 5 members, at most 2 of them nested, at most 800 characters of scalars."""
    if not isinstance(obj, dict) or not ENTITY_MEMBERS[0] <= len(obj) <= ENTITY_MEMBERS[1]:
        return False
    nested = [isinstance(v, (dict, list)) for v in obj.values()]
    chars = sum(len(str(v)) for v, n in zip(obj.values(), nested) if not n)
    return sum(nested) <= ENTITY_NESTED and chars <= ENTITY_CHARS


def chunk_id(file_path: Column, path: Column) -> Column:
    """Stable id of a chunk: md5 of the file path without leading slashes, a colon and the bare path."""
    bare = F.regexp_replace(F.replace(path, F.lit(" "), F.lit("")), r"^\.+|\.+$", "")
    return F.md5(F.concat(F.regexp_replace(file_path, "^/+", ""), F.lit(":"), bare).cast("binary"))


def _hybrid(root, whole: bool) -> Iterator[tuple]:
    """(path, value, context, parent path, metadata) in document order."""
    todo = [(root, "", "", {})]
    while todo:
        v, path, above, ctx = todo.pop()
        if isinstance(v, dict):
            if whole and entity_like(v):
                yield path, v, ctx, above, {"has_children": any(isinstance(x, (dict, list)) for x in v.values()), "chunked_as_entity": True, "field_count": len(v)}
            elif not v:
                yield path, v, ctx, above, {"has_children": False}
            else:
                inner = ctx | {(f"{path}_{k}" if path else k): x for k, x in v.items() if not isinstance(x, (dict, list))}
                todo += [(x, f"{path}.{k}" if path else k, path, inner) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            if v and all(isinstance(x, dict) for x in v) and any(map(entity_like, v)):
                for i, x in enumerate(v):
                    yield f"{path}[{i}]", x, ctx, above, {"is_collection_item": True, "collection_path": path, "item_index": i, "chunked_as_entity": True}
            else:
                todo += [(v[i], f"{path}[{i}]", path, ctx) for i in range(len(v) - 1, -1, -1)]
        else:
            yield path, v, ctx, above, {"is_primitive": True, "value_type": _PYTHON_KIND[type(v)]}


def _leaves(root) -> Iterator[tuple]:
    """Scalars with every member on the way to them as context."""
    todo = [(root, "", {})]
    while todo:
        v, path, ctx = todo.pop()
        if isinstance(v, dict):
            todo += [(x, f"{path}.{k}" if path else k, ctx | {k: x}) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(v[i], f"{path}[{i}]", ctx) for i in range(len(v) - 1, -1, -1)]
        else:
            yield path, v, ctx, None, {"value_type": _PYTHON_KIND[type(v)]}


_NAMES = ["row_key", "file_path", "ordinal", "path", "chunk_json", "context", "parent_path", "value_type", "metadata"]
_TYPES = [pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 6]


def _run(split, most: int | None, context: bool):
    def batch_of(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(_NAMES)
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, _TYPES)], _NAMES)

    dump = lambda v: clean(json.dumps(v, ensure_ascii=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for key, file, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ok, doc = document(text)
                if not ok:
                    continue
                for n, (path, v, ctx, above, meta) in enumerate(split(doc)):
                    if most is not None and n >= most:
                        break
                    rows.append((key, file, n, clean(path), dump(v), dump(ctx) if context else None, None if above is None else clean(above), _PYTHON_KIND[type(v)], dump(meta)))
                    chars += len(rows[-1][4]) + len(rows[-1][5] or "")
                    if len(rows) >= 2048 or chars >= FLUSH_CHARS:  # contexts of a wide object are long, all of them together
                        yield batch_of(rows)
                        rows, chars = [], 0
            yield batch_of(rows)

    return run


def _chunks(df: DataFrame, key: str, file: str, text: str, split, most: int | None, context: bool) -> DataFrame:
    got = spread(df.select(F.col(key).cast("bigint"), F.col(file), F.col(text))).mapInArrow(_run(split, most, context), "row_key bigint, file_path string, ordinal int, path string, chunk_json string, context string, parent_path string, value_type string, metadata string")
    parent = F.when(F.col("parent_path").isNotNull(), chunk_id(F.col("file_path"), F.col("parent_path")))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", r"\.")))
    return got.withColumns({"chunk_id": chunk_id(F.col("file_path"), F.col("path")), "parent_id": parent, "depth": depth})


def json_chunks(df: DataFrame, key: str, file: str, text: str, strategy: str = "hybrid", most: int | None = None, context: bool = True) -> DataFrame:
    """Chunks of each document, the first `most` of them in document order (None: all).

    context: also what stands around each chunk, which can be much longer than the chunk.
    """
    whole = strategy == "hybrid"
    return _chunks(df, key, file, text, lambda d: _hybrid(d, whole), most, context)


def leaf_chunks(df: DataFrame, key: str, file: str, text: str, most: int | None = None, context: bool = True) -> DataFrame:
    """Scalars of each document as chunks."""
    return _chunks(df, key, file, text, _leaves, most, context)


def hierarchy_info(chunks: DataFrame) -> DataFrame:
    has = F.coalesce(F.get_json_object("metadata", "$.has_children").cast("boolean"), F.lit(False))
    return chunks.select("chunk_id", "parent_id", "depth", "path", has.alias("has_children"))


def parents(chunks: DataFrame, levels: int = 3) -> DataFrame:
    """(chunk_id, level, parent) for up to `levels` stored ancestors, level 1 the nearest.

    The bound on levels makes it a chain of equi-joins on the parent id.
    """
    links = chunks.select("chunk_id", "parent_id").where("parent_id is not null and parent_id <> chunk_id").distinct()
    step = links.join(chunks.select(F.col("chunk_id").alias("parent_id")).distinct(), "parent_id").select("chunk_id", F.col("parent_id").alias("parent"))
    out, now = None, step
    for k in range(1, levels + 1):
        here = now.withColumn("level", F.lit(k))
        out = here if out is None else out.unionByName(here)
        now = now.join(step.select(F.col("chunk_id").alias("parent"), F.col("parent").alias("_up")), "parent").select("chunk_id", F.col("_up").alias("parent"))
    return out.select("chunk_id", "level", "parent")


def children(chunks: DataFrame, levels: int = 2) -> DataFrame:
    """(chunk_id, level, child): stored descendants down to `levels`."""
    return parents(chunks, levels).select(F.col("parent").alias("chunk_id"), "level", F.col("chunk_id").alias("child"))


def with_context(chunks: DataFrame, up: int = 3, down: int = 2, most: int | None = None) -> DataFrame:
    """(chunk_id, text): lines for the stored parents, the chunk and its children, root first.

    most: of the children of a chunk only the first so many, by level, ordinal and line. Without it
    the text of a chunk with very many children is as long as all of them.
    """
    line = lambda word: F.concat(F.lit(word), F.lit(" ("), "path", F.lit("): "), "chunk_json")
    body = chunks.select("chunk_id", "path", "chunk_json", "ordinal")
    p = parents(chunks, up).join(body.withColumnRenamed("chunk_id", "parent"), "parent").select("chunk_id", (-F.col("level")).alias("place"), "ordinal", line("Parent").alias("line"))
    c = children(chunks, down).join(body.withColumnRenamed("chunk_id", "child"), "child").select("chunk_id", "level", "ordinal", line("Child").alias("line")).withColumnRenamed("level", "place")
    if most is not None:
        order = ["place", "ordinal", "line"]
        salted = Window.partitionBy("chunk_id", F.pmod(F.xxhash64("line"), F.lit(64))).orderBy(*order)
        c = c.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= most)
        c = c.withColumn("_r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*order))).where(F.col("_r") <= most).drop("_r")
    own = body.select("chunk_id", F.lit(0).alias("place"), "ordinal", F.concat(F.lit("Current: "), "chunk_json").alias("line"))
    rows = p.unionByName(own).unionByName(c)
    return rows.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "ordinal", "line"))), lambda x: x["line"]), "\n").alias("text"))

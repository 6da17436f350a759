"""Chunks with tagged values, context and metadata."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions import scalars as S
from jsonloom.functions.jsonwalk import clean, document, kind, loads
from jsonloom.session import spread

SAMPLE = 3
SHOWN = 100


def tag(v) -> dict:
    """A value with its type; of a container the size, the keys and its first members, not all of it."""
    if v is None:
        return {"type": "null"}
    if not isinstance(v, (dict, list)):
        return {"type": "primitive", "kind": kind(v), "value": v}
    own = {"type": "complex", "kind": kind(v), "size": len(v)}
    if isinstance(v, dict):
        return own | {"keys": list(v), "sample": {k: kind(v[k]) for k in list(v)[:SAMPLE]}}
    kinds: dict[str, int] = {}
    for x in v:
        kinds[kind(x)] = kinds.get(kind(x), 0) + 1
    return own | {"kinds": kinds, "sample": [x if not isinstance(x, (dict, list)) else kind(x) for x in v[:SAMPLE]]}


def tagged(chunk_json: Column) -> Column:
    """The tag of a JSON text as JSON; null if it is no JSON."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            try:
                out.append(clean(json.dumps(tag(loads(t)), ensure_ascii=False)) if t else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(chunk_json)


#: Characters beyond which a JSON text, and a container in it, is shown shortened.
LONG, LONG_MEMBER = 500, 200


def shrunk(chunk_json: Column) -> Column:
    """A long JSON text with its long containers shortened: of an object the first members, of an array the number of its items."""

    def short(v):
        if isinstance(v, dict) and len(json.dumps(v)) > LONG_MEMBER:
            return {k: "..." for k in list(v)[:SAMPLE]}
        if isinstance(v, list) and len(json.dumps(v)) > LONG_MEMBER:
            return ["...", f"({len(v)} items total)"]
        return v

    def one(t):
        if not isinstance(t, str) or len(t) <= LONG:
            return t
        try:
            v = loads(t)
        except ValueError:
            return t
        return clean(json.dumps({k: short(x) for k, x in v.items()}, ensure_ascii=False)) if isinstance(v, dict) else t

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in s], dtype=object)

    return run(chunk_json)


def enhance(chunks: DataFrame) -> DataFrame:
    """Chunks with tagged value, path depth, kind and category, and what their scalar tells as number, text and time."""
    raw = F.when(F.col("value_type") == "str", F.get_json_object(F.concat(F.lit('{"v":'), "chunk_json", F.lit("}")), "$.v"))
    number = F.when(F.col("value_type").isin("int", "float"), F.col("chunk_json").try_cast("double"))
    p = F.col("path")
    return chunks.withColumns({"tagged": tagged(F.col("chunk_json")), "chunk_version": F.lit("2.0"), "path_depth": S.path_depth(p), "path_kind": S.path_kind(p), "path_category": S.path_category(p), "numeric_meta": F.when(number.isNotNull(), S.numeric_meta(number)), "string_meta": F.when(raw.isNotNull(), S.string_meta(raw)), "temporal_meta": F.when(S.find_timestamp(raw).isNotNull(), S.temporal_meta(raw))})


def _ancestors(levels: int):
    def cut(v) -> str:
        t = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return clean(t if len(t) <= SHOWN else t[:SHOWN] + "...")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ok, doc = document(text)
                todo = [(doc, "$", ())] if ok else []
                while todo:
                    v, path, above = todo.pop()
                    if isinstance(v, (dict, list)):
                        line = (*above, (path, v))[-levels:]
                        named = v.items() if isinstance(v, dict) else enumerate(v)
                        todo += [(x, f"{path}.{k}" if isinstance(v, dict) else f"{path}[{k}]", line) for k, x in named]
                    else:
                        rows += [(key, clean(path), n, clean(p), cut(a)) for n, (p, a) in enumerate(reversed(above), 1)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()])], ["row_key", "path", "level", "ancestor", "shown"])

    return run


def ancestor_context(df: DataFrame, key: str, text: str, levels: int = 3) -> DataFrame:
    """(row_key, path, level, ancestor, shown): the containers around each scalar, nearest first, as text of at most 100 characters."""
    return spread(df.select(F.col(key).cast("bigint"), F.col(text))).mapInArrow(_ancestors(levels), "row_key bigint, path string, level int, ancestor string, shown string")

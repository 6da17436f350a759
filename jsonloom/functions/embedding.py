"""Vectors of texts. The default provider hashes words; it is deterministic and no semantic model."""

from __future__ import annotations

import re
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384
WORD = re.compile(r"\w+")


def hash_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Signed word counts hashed to `dim` numbers, of length 1; a text without words is all zero."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in WORD.findall(t.lower()):
            h = crc32(w.encode())
            out[i, (h >> 1) % dim] += 1 if h & 1 else -1
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def embed(text: Column, provider: Callable[[list[str]], np.ndarray] = hash_vectors) -> Column:
    """Vectors of a text column by a provider of batches; null and empty texts give null."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        ok = [isinstance(t, str) and t != "" for t in s]
        vectors = iter(provider([t for t, o in zip(s, ok) if o]))
        return pd.Series([next(vectors) if o else None for o in ok], dtype=object)

    return run(text)


# Members put in front of a text, by the kind of object it is; of a metric all numbers are.
FRONT = {"entity_definition": ["id", "name", "type", "code"], "event": ["timestamp", "date", "created_at", "status", "state", "type"]}
#: The kind that an archetype is embedded as.
KIND_OF = {"entity_collection": "entity_definition", "event_log": "event", "metric_data": "metric"}


def fronted(text: Column, fields: Column, archetype: Column) -> Column:
    """The text with the telling members of its JSON object in front, as member:value, by its archetype."""

    def front(parts: Column) -> Column:
        return F.trim(F.concat_ws(" ", parts, text))

    out = text
    for name, kind in KIND_OF.items():
        if kind in FRONT:
            parts = F.array_compact(F.array(*[F.concat(F.lit(f"{k}:"), F.get_json_object(fields, f"$.{k}")) for k in FRONT[kind]]))
        else:
            own = F.filter(F.map_entries(F.from_json(fields, "map<string,string>")), lambda e: e["value"].rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"))
            parts = F.transform(own, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
        out = F.when(archetype == name, front(F.coalesce(parts, F.array().cast("array<string>")))).otherwise(out)
    return out

"""Functions of the engine for use in SQL text: `register(spark)` makes them known to a session.

- json_nodes(text): a table function with one row for each value below the root of a JSON document
- normalize_json_path(path): as `scalars.normalize_path`
- hash_embedding(text): as `embedding.embed` with the default provider
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from jsonloom.functions.embedding import hash_vectors
from jsonloom.functions.jsonwalk import clean, document, kind, text_of, walk


@F.udtf(returnType="path string, parent_path string, member string, kind string, value string, depth int")
class JsonNodes:
    """The nodes of one document, in its order; none for a null, empty or invalid text."""

    def eval(self, text: str):
        ok, doc = document(text)
        for path, above, ords, member, v, _, _ in walk(doc) if ok else ():
            box = isinstance(v, (dict, list))
            yield clean(path), clean(above), None if member is None else clean(member), kind(v), None if box else text_of(v), len(ords)


def register(spark: SparkSession) -> None:
    @F.pandas_udf("array<float>")
    def hash_embedding(s: pd.Series) -> pd.Series:
        return pd.Series([hash_vectors([t])[0] if isinstance(t, str) and t else None for t in s], dtype=object)

    spark.udtf.register("json_nodes", JsonNodes)
    spark.udf.register("hash_embedding", hash_embedding)
    spark.sql("create or replace temporary function normalize_json_path(p string) returns string return trim(both '.' from regexp_replace(regexp_replace(replace(p, ' ', ''), '\\\\[(\\\\d+)\\\\]', '.$1'), '\\\\.{2,}', '.'))")

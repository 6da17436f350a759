"""JSON files as rows, and which of them changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.operators.nested import opened


def json_files(spark: SparkSession, folder: str, skip: tuple[str, ...] = ("test_queries",)) -> DataFrame:
    """(filename, file_hash, last_modified, raw, corrupt) of all .json files below a folder.

    corrupt: not valid JSON; such files are listed, not dropped, and give no chunks later.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    raw = F.col("content").cast("string")
    name = F.element_at(F.split("path", "/"), -1)
    return f.where(~name.isin(*skip) if skip else F.lit(True)).select(F.col("path").alias("filename"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("last_modified"), raw.alias("raw"), F.try_parse_json(raw).isNull().alias("corrupt"))


def changed(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs from the registry's."""
    return files.join(registry.select(F.col("file_path").alias("filename"), "file_hash"), ["filename", "file_hash"], "left_anti")


def object_roots(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The documents (row_key, t) whose root is an object."""
    return opened(docs, key, text).where(F.try_variant_get("v", "$", "map<string,variant>").isNotNull()).select("row_key", "t")

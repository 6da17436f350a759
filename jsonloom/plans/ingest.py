"""Ingestion: changed files to chunks, vectors, key values, archetypes, summaries and edges in the store.

All that a file has in the store is replaced when it changed, so nothing of an earlier version stays.
A file that can no longer be read keeps what it had, and is noted as corrupt.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.functions.embedding import embed, fronted
from jsonloom.operators import archetypes as A
from jsonloom.operators import chunks as C
from jsonloom.operators import relations as R
from jsonloom.operators.nodes import json_nodes, key_value_pairs
from jsonloom.operators.summaries import group_summary
from jsonloom.session import written
from jsonloom.sources.files import changed, json_files
from jsonloom.sources.store import Store

log = logging.getLogger("jsonloom")


def _text(chunk_json: str):
    """The text of a chunk that is a JSON string."""
    return F.get_json_object(F.concat(F.lit('{"v":'), chunk_json, F.lit("}")), "$.v")


def identifiers(chunks: DataFrame) -> DataFrame:
    """(file_path, chunk, ordinal, path, value) of the chunks that are the value of an identifier."""
    c = chunks.where("value_type = 'str'").select("file_path", F.col("chunk_id").alias("chunk"), "ordinal", "path", _text("chunk_json").alias("value"))
    return c.where(R.holds_identifier(F.col("path")) & (F.col("value") != ""))


def mentions(chunks: DataFrame) -> DataFrame:
    """(file_path, chunk, path, field, value): textual id and *_id members in the context of chunks."""
    e = chunks.select("file_path", F.col("chunk_id").alias("chunk"), "path", F.explode(F.map_entries(F.from_json("context", "map<string,string>"))).alias("e"))
    return e.select("file_path", "chunk", "path", F.col("e.key").alias("field"), F.col("e.value").alias("value")).where("value <> '' and (field = 'id' or field like '%\\\\_id')")


def _link(store: Store, files: DataFrame, before: DataFrame) -> None:
    """The edges of files whose identifiers or mentions changed; before: the values that the changed files held."""
    ids, said = store.read("chunk_ids"), store.read("chunk_mentions")
    held = ids.join(files, "file_path", "left_semi").select("value")
    values = before.unionByName(held).distinct()
    concerned = said.join(values, "value", "left_semi").select("file_path").unionByName(files.select("file_path")).distinct()
    concerned = written(concerned, "files-to-link")
    own = said.join(concerned, "file_path", "left_semi")
    edges = R.reference_edges(ids, own.drop("file_path")).join(own.select(F.col("chunk").alias("source"), "file_path").distinct(), "source")
    store.replace("chunk_relationships", edges, concerned)


def ingest_rows(files: DataFrame, store: Store, most: int | None = None) -> None:
    """Take (filename, file_hash, last_modified, raw, corrupt) rows into the store.

    most: only the first chunks of each document, so many of them (None: all).
    """
    docs = files.where("not corrupt").select(F.xxhash64("filename").alias("row_key"), "filename", "raw")
    names = written(docs.select(F.col("filename").alias("file_path")), "ingest-files")
    before = written(store.read("chunk_ids").join(names, "file_path", "left_semi").select("value"), "ids-before")
    got = written(C.json_chunks(docs, "row_key", "filename", "raw", most=most), "ingest-chunks")
    if most is not None:
        log.warning("documents are cut after %d chunks each", most)
    nodes = json_nodes(docs, "row_key", "raw")
    of = docs.select("row_key", F.col("filename").alias("file_path"))
    kv = key_value_pairs(nodes).join(of, "row_key").withColumn("chunk_id", C.chunk_id(F.col("file_path"), F.col("path")))
    store.replace("chunk_key_values", kv, names)
    ranked = A.rank_archetypes(A.json_objects(docs, "row_key", "raw")).join(of, "row_key").withColumn("chunk_id", C.chunk_id(F.col("file_path"), F.col("node_path")))
    ranked = written(ranked.join(got.where("value_type = 'dict'").select("file_path", "chunk_id"), ["file_path", "chunk_id"], "left_semi"), "ingest-archetypes")
    store.replace("chunk_archetypes", ranked, names)
    top = ranked.where("rank = 1").select("file_path", "chunk_id", "archetype").dropDuplicates(["file_path", "chunk_id"])
    text = fronted(F.col("chunk_json"), F.col("chunk_json"), F.col("archetype"))
    store.replace("json_chunks", got.join(top, ["file_path", "chunk_id"], "left").withColumns({"embedding": embed(text), "updated_at": F.current_timestamp()}), names)
    store.replace("group_parts", group_summary(got.where("value_type = 'dict'"), "chunk_json", within=["file_path"]), names)
    store.replace("chunk_ids", identifiers(got), names)
    store.replace("chunk_mentions", mentions(got), names)
    _link(store, names, before)
    seen = files.select(F.col("filename").alias("file_path"), "file_hash", "last_modified", F.current_timestamp().alias("last_processed"), "corrupt")
    store.replace("file_metadata", seen, seen.select("file_path"))


def ingest(spark: SparkSession, folder: str, root: str, prune: bool = False) -> int:
    """Ingest the files below a folder that are new or changed; the number of those files.

    prune: also remove what is stored of files that are no longer there.
    """
    store = Store(spark, root)
    every, known = json_files(spark, folder), store.read("file_metadata")
    if prune:
        gone = written(known.select("file_path").join(every.select(F.col("filename").alias("file_path")), "file_path", "left_anti"), "gone-files")
        if gone.limit(1).count():
            before = written(store.read("chunk_ids").join(gone, "file_path", "left_semi").select("value"), "ids-before")
            for name in ("json_chunks", "chunk_key_values", "chunk_archetypes", "group_parts", "chunk_ids", "chunk_mentions", "file_metadata"):
                store.replace(name, store.read(name).limit(0), gone)
            _link(store, gone, before)
    new = written(changed(every, store.read("file_metadata")), "ingest-files")
    n = new.count()
    log.info("%d new or changed files below %s", n, folder)
    if n:
        ingest_rows(new, store)
    return n

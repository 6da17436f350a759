"""Tables of what was ingested, on a shared file system, replaced by file.

Each row belongs to a file, and rows lie in buckets by a hash of its name. A change writes the buckets
of the files concerned anew and then a manifest that names the folder of every bucket; the manifest is
what readers go by, so they see a change as a whole or not at all, and a lost job leaves nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.session import broadcast_if_small

SCHEMAS = {
    "json_chunks": "file_path string, chunk_id string, path string, parent_path string, parent_id string, depth int, ordinal int, chunk_json string, value_type string, context string, embedding array<float>, metadata string, updated_at timestamp",
    "file_metadata": "file_path string, file_hash string, last_modified timestamp, last_processed timestamp, corrupt boolean",
    "chunk_key_values": "file_path string, chunk_id string, key_name string, value_text string, data_type string, path string",
    "chunk_archetypes": "file_path string, chunk_id string, archetype string, confidence double",
    "chunk_ids": "file_path string, chunk string, ordinal int, path string, value string",
    "chunk_mentions": "file_path string, chunk string, path string, field string, value string",
    "chunk_relationships": "file_path string, source string, target string, relationship_type string, confidence double, metadata string",
    "group_parts": "file_path string, group_key string, group_type string, n bigint, total double",
}
KEYS = {
    "json_chunks": ["file_path", "chunk_id"],
    "file_metadata": ["file_path"],
    "chunk_key_values": ["file_path", "chunk_id", "key_name", "path"],
    "chunk_archetypes": ["file_path", "chunk_id", "archetype"],
    "chunk_ids": ["file_path", "chunk", "path", "value"],
    "chunk_mentions": ["file_path", "chunk", "field", "value"],
    "chunk_relationships": ["file_path", "source", "target", "relationship_type"],
    "group_parts": ["file_path", "group_key", "group_type"],
}
BUCKETS = 64


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of several rows of a key the largest."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests ------------------------------------------------------------------------------------

    def _versions(self, name: str) -> list[int]:
        at = self._path(f"{self.root}/{name}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(n[1:-5]) for s in self._fs.listStatus(at) if (n := s.getPath().getName()).endswith(".json"))

    def _manifest(self, name: str, version: int | None = None) -> dict:
        """{buckets, paths}: the folder of each bucket that holds rows."""
        versions = self._versions(name)
        if not versions:
            return {"buckets": self.buckets, "paths": {}}
        stream = self._fs.open(self._path(f"{self.root}/{name}/manifests/v{versions[-1] if version is None else version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, manifest: dict) -> None:
        versions = self._versions(name)
        n = versions[-1] + 1 if versions else 0
        tmp, to = (self._path(f"{self.root}/{name}/{x}") for x in (f".{uuid.uuid4().hex}", f"manifests/v{n}.json"))
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(to.getParent())
        if not self._fs.rename(tmp, to):
            raise RuntimeError(f"another job changed {name} at the same time")
        for old in versions[:-1]:  # the manifest before the new one stays for readers
            kept = {p for v in (None, versions[-1]) for p in self._manifest(name, v)["paths"].values()}
            for p in set(self._manifest(name, old)["paths"].values()) - kept:
                self._fs.delete(self._path(f"{self.root}/{name}/{p}"), True)
            self._fs.delete(self._path(f"{self.root}/{name}/manifests/v{old}.json"), False)

    # -- tables ---------------------------------------------------------------------------------------

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")

    def read(self, name: str, only: set[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        paths = [f"{self.root}/{name}/{p}" for b, p in self._manifest(name)["paths"].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def replace(self, name: str, rows: DataFrame, files: DataFrame) -> None:
        """Rows take the place of all rows of the files (file_path); only the buckets of these files are written."""
        manifest = self._manifest(name)
        bucket = self._bucket(manifest["buckets"])
        touched = {r[0] for r in files.select(bucket).distinct().collect()}  # at most so many as buckets
        if not touched:
            return
        old = self.read(name, touched).join(broadcast_if_small(files.select("file_path").distinct()), "file_path", "left_anti")
        cols = old.columns
        new = old.unionByName(one_per_key(rows.select(*cols), KEYS[name])).withColumn("bucket", bucket)
        folder = f"data-{uuid.uuid4().hex}"
        new.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
        written = {s.getPath().getName().split("=")[1] for s in self._fs.listStatus(self._path(f"{self.root}/{name}/{folder}")) if s.getPath().getName().startswith("bucket=")}
        paths = {b: p for b, p in manifest["paths"].items() if int(b) not in touched} | {b: f"{folder}/bucket={b}" for b in written}
        self._commit(name, {"buckets": manifest["buckets"], "paths": paths})

    def reset(self) -> None:
        """Remove all tables."""
        for name in SCHEMAS:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    # -- lookups --------------------------------------------------------------------------------------

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.read("json_chunks").where(F.col("chunk_id") == chunk_id)

    def archetypes(self, chunk_id: str) -> DataFrame:
        return self.read("chunk_archetypes").where(F.col("chunk_id") == chunk_id).orderBy(F.desc("confidence"), "archetype")

    def with_values(self, wanted: dict[str, str]) -> DataFrame:
        """The chunks that have all these key=value pairs among their members."""
        kv = self.read("chunk_key_values")
        hit = None
        for k, v in wanted.items():
            own = kv.where((F.col("key_name") == k) & (F.col("value_text") == v)).select("chunk_id").distinct()
            hit = own if hit is None else hit.join(own, "chunk_id", "left_semi")
        chunks = self.read("json_chunks")
        return chunks if hit is None else chunks.join(hit, "chunk_id", "left_semi")

    def summaries(self) -> DataFrame:
        """(group_key, group_type, n, total) over all files."""
        return self.read("group_parts").groupBy("group_key", "group_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

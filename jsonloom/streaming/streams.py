"""Streams: incremental file ingestion and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.plans.ingest import ingest_rows
from jsonloom.sources.files import changed
from jsonloom.sources.store import Store


def stream_ingest(spark: SparkSession, folder: str, root: str, checkpoint: str):
    """Ingest files as they arrive, each once; what is there when it starts is taken and then it ends."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    raw = F.col("content").cast("string")
    rows = files.select(F.col("path").alias("filename"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("last_modified"), raw.alias("raw"), F.try_parse_json(raw).isNull().alias("corrupt"))

    def take(batch: DataFrame, _: int) -> None:
        store = Store(spark, root)
        ingest_rows(changed(batch, store.read("file_metadata")), store)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; works on a stream (late events beyond `late` are dropped) and a table."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user: events no more than `gap` apart."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), "n")


def run_once(spark: SparkSession, source: DataFrame, folder: str) -> DataFrame:
    """Run a streaming query over what is there into parquet files and read them."""
    q = source.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{folder}/out")

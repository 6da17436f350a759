"""Session settings and the few helpers that touch cluster state (shared folder, size checks)."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; every use counts the side first.
BROADCAST_ROWS = 200_000


def get_spark(app: str = "jsonloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow; used by tests, bench and the command line."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a session on one machine may name none (tests, a laptop); it gets a local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + os.path.join(tempfile.gettempdir(), "jsonloom-shared")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Folders of intermediate tables by session; they are removed with it, or by `clean`.
_made: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for an intermediate table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_at_exit)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as parquet below the shared folder and read it back.

    Results are lazy and read these tables, so they stay until `clean` or the end of the program.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Remove the intermediate tables of this session; results not yet computed can no longer be read."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        delete(spark, p)
    return len(paths)


def _at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            clean(spark)
    except Exception:  # noqa: BLE001
        pass  # the JVM is gone already


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted, stopping there), else df."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, in at least as many partitions as there are cores, for costly work on each row.

    For scans and what is narrow on them; a table in many files is left as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)

"""Joins on closeness in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, key: str, at: str, micros: int) -> DataFrame:
    """Pairs of rows with the same key whose times differ by at most `micros`; gap = right - left.

    Both sides are cut into buckets of `micros`; a left row also looks into the two neighbouring
    buckets. So the join is an equi-join on (key, bucket), and a hot key is spread over its buckets.
    Rows without key or time pair with nothing. Further columns of the right side that the left side
    has too get the suffix _right.
    """
    for c in right.columns:
        if c in left.columns and c not in (key, at):
            right = right.withColumnRenamed(c, f"{c}_right")
    l = left.where(F.col(key).isNotNull() & F.col(at).isNotNull())  # noqa: E741
    r = right.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    size = F.lit(max(1, micros))
    bucket = F.floor(F.col(at) / size).cast("bigint")
    l = l.withColumn("_b", F.explode(F.sequence(bucket - 1, bucket + 1))).withColumnRenamed(at, "_la")  # noqa: E741
    r = r.withColumn("_b", bucket).withColumnRenamed(at, "_ra")
    both = l.join(r, [key, "_b"]).withColumn("gap", F.col("_ra") - F.col("_la"))
    return both.where(F.abs("gap") <= micros).drop("_b", "_la", "_ra")

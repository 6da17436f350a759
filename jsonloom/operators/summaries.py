"""Summaries per group of JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.scalars import group_key, group_type


def group_summary(records: DataFrame, fields: str, value: str | None = None, rollup: bool = False, within: list[str] | None = None) -> DataFrame:
    """(group_key, group_type, n, total) of JSON objects; rollup adds a row per type and one for all; within: columns that divide groups further.

    Only sums and counts are shuffled; ids of the records of a group are a join away and not collected.
    """
    within = within or []
    g = records.select(*within, group_key(F.col(fields)).alias("group_key"), group_type(F.col(fields)).alias("group_type"), (F.col(value) if value else F.get_json_object(fields, "$.value").try_cast("double")).cast("double").alias("_v"))
    aggs = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.round(F.col("_v") * 100).cast("bigint")) / 100.0, F.lit(0.0)).alias("total")]
    return (g.rollup("group_type", "group_key") if rollup else g.groupBy(*within, "group_key", "group_type")).agg(*aggs).select(*within, "group_key", "group_type", "n", "total")

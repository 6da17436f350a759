"""Columns for dirty keys, ISO timestamps and 'the last delivery counts'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters trimmed from keys.
BLANKS = " \t\n\r\x0b\x0c\u00a0"


def norm_key(c: Column) -> Column:
    """The key a dirty cell denotes: blanks trimmed, upper case; null and blank are no key."""
    k = F.upper(F.btrim(c, F.lit(BLANKS)))
    return F.when(k != "", k)


def iso_micros(c: Column) -> Column:
    """Microseconds since 1970 (UTC) of an ISO-8601 text; no zone means UTC, unreadable gives null."""
    t = F.trim(c)
    sign = lambda k: F.substring(t, -k, 1).isin("+", "-")
    clock = F.contains(t, F.lit(":"))
    zoned = F.when(~clock, F.concat(t, F.lit("T00:00:00Z"))).when(F.substring(t, -1, 1).isin("Z", "z") | sign(6) | sign(5) | sign(3), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(F.when(F.substring(t, 5, 1) == "-", zoned).try_cast("timestamp"))


def micros(c: Column) -> Column:
    """Microseconds of a TIMESTAMP column without zone, read as UTC (sessions run in UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the one with the largest `order` columns, compared in turn.

    An aggregate with map-side combine, so a hot key costs no large group; nulls sort first.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in rest]).alias("_row")))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col(f"_best._row.`{c}`").alias(c) for c in rest])

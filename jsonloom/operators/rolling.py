"""Totals and averages over trailing periods, idle days included (problem 6).

Activity is pre-aggregated to one row per entity and day. Days are cut into tiles of `TILE` days;
a day also goes to the next tile if that tile's first windows reach back to it (the halo). A block
of entities in a tile becomes a dense numpy matrix, multiplied by banded window operators.
Amounts are whole cents, so sums are exact.

Defined cases: rows without entity or day are left out; a null amount counts 0 but is activity;
each entity covers every day from its first to its last active day; an empty table gives nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.keys import iso_micros, latest, norm_key
from jsonloom.operators.snapshots import micros_or_zero
from jsonloom.session import written

TILE = 64
#: Entities in a block, about: a dense block then takes TILE + halo times this many numbers.
ENTITIES = 1024
#: Sums of whole cents up to this are exact in the float64 products; larger ones are refused.
MAX_CENTS = 2**53


def _band(window: int, halo: int, days: int) -> np.ndarray:
    """B with (x @ B)[d] = sum of x over the `window` days that end with day d of the tile."""
    at = np.arange(halo + days)[:, None] - halo - np.arange(days)[None, :]
    return ((at <= 0) & (at > -window)).astype(np.float64)


def _tile(windows: list[int], halo: int, idle: int | None, least: int | None):
    bands = {w: _band(w, halo, TILE) for w in windows}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = int(pdf["tile"].iloc[0])
        start = tile * TILE
        code, who = pd.factorize(pdf["entity"])
        first, last = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
        first[code], last[code] = pdf["first"].to_numpy(), pdf["last"].to_numpy()
        cents, n = np.zeros((len(who), halo + TILE)), np.zeros((len(who), halo + TILE))
        real = pdf["day"].notna().to_numpy()
        at = (pdf["day"].to_numpy(np.float64)[real] - start + halo).astype(np.int64)
        cents[code[real], at], n[code[real], at] = pdf["cents"].to_numpy(np.float64)[real], pdf["n"].to_numpy(np.float64)[real]
        days = start + np.arange(TILE)
        keep = (days[None, :] >= first[:, None]) & (days[None, :] <= last[:, None])
        if (np.abs(cents) @ np.ones(halo + TILE)).max(initial=0) > MAX_CENTS:
            raise ValueError(f"amounts of an entity beyond {MAX_CENTS} cents in one tile")
        sums = {w: (np.rint(cents @ b), np.rint(n @ b)) for w, b in bands.items()}
        if idle is not None:
            keep &= sums[idle][1] == 0
        if least is not None:
            keep &= sums[max(windows)][0] >= least
        e, d = np.nonzero(keep)
        out = {"entity": who.to_numpy()[e] if hasattr(who, "to_numpy") else who[e], "day": days[d]}
        for w, (s, k) in sums.items():
            out[f"cents_{w}"], out[f"orders_{w}"] = s[e, d].astype(np.int64), k[e, d].astype(np.int64)
        return pd.DataFrame(out)

    return run


def trailing(daily: DataFrame, windows: list[int], idle: int | None = None, least: int | None = None) -> DataFrame:
    """(entity, day, cents_w, orders_w per window w) for daily rows (entity, day INT, cents, n).

    idle and least are filters applied inside the blocks: no activity in the last `idle` days, and
    at least `least` cents in the longest window.
    """
    halo = max(windows) - 1
    daily = written(daily, "daily")  # read for the spans, their number and the blocks
    spans = daily.groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    tile = lambda c: F.floor(F.col(c) / TILE).cast("bigint")
    frames = spans.select("entity", "first", "last", F.explode(F.sequence(tile("first"), tile("last"))).alias("tile"))
    reach = F.floor((F.col("day") + halo) / TILE).cast("bigint")
    acts = daily.select("entity", F.explode(F.sequence(tile("day"), reach)).alias("tile"), "day", "cents", "n")
    # every framed tile has its row, active or not; tiles after the last day have no frame
    rows = frames.join(acts, ["entity", "tile"], "left")
    blocks = max(1, spans.count() // ENTITIES)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("bigint"))
    schema = "entity string, day bigint, " + ", ".join(f"cents_{w} bigint, orders_{w} bigint" for w in windows)
    return rows.groupBy("tile", "block").applyInPandas(_tile(windows, halo, idle, least), schema)


def daily_amounts(orders: DataFrame) -> DataFrame:
    """Orders as they stand, summed per customer key and UTC day."""
    at = F.coalesce(iso_micros(F.col("timestamp")), iso_micros(F.col("transaction_date")))
    o = orders.where("order_id is not null").select("order_id", micros_or_zero("ingested_at").alias("seen"), "record_id", norm_key(F.col("customer_id")).alias("entity"), F.floor(at / 86_400_000_000).cast("bigint").alias("day"), F.round(F.col("total_amount") * 100).cast("bigint").alias("cents"))
    o = latest(o, ["order_id"], "seen", "record_id").where("entity is not null and day is not null")
    return o.groupBy("entity", "day").agg(F.coalesce(F.sum("cents"), F.lit(0).cast("bigint")).alias("cents"), F.count(F.lit(1)).alias("n"))


def day_text(c: str):
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col(c).cast("int")), "yyyy-MM-dd")

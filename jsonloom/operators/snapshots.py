"""What changed between consecutive full snapshots (problem 7).

Keys get persistent ordinals, given once and never again. Per snapshot and block of 65,536 ordinals
the present keys are one compressed bitmap (an array of positions, runs or plain bits, whichever is
smallest) with vectors of the compared values aligned to it. Ordinals and blocks are kept in a
`History`; consecutive snapshots meet block by block, so a shuffle carries blocks, not rows.
AND-NOT of two bitmaps gives additions and removals, the aligned vectors the changes.

Defined cases: rows without a key or snapshot are left out; of several rows of a key in a snapshot
the one with the latest ingested_at counts, then the largest record_id; values are equal if both
are null or both the same; the first snapshot gives nothing; an empty table gives nothing; a
snapshot that is not later than those kept is refused.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jsonloom.functions.keys import latest, norm_key
from jsonloom.session import broadcast_if_small, exists, scratch, written

BLOCK = 1 << 16
#: Stands for null in a vector of values; a value that happens to equal it is moved by one.
NULL = -(2**63)
ARRAY, RUNS, BITS = 0, 1, 2


class Bitmap:
    """A set of positions below BLOCK in the smallest of three containers."""

    def __init__(self, kind: int, data: np.ndarray):
        self.kind, self.data = kind, data

    @staticmethod
    def of(low: np.ndarray) -> Bitmap:
        """Of sorted distinct positions."""
        cut = np.flatnonzero(np.diff(low) != 1) + 1
        first = low[np.append(0, cut)] if len(low) else low
        last = low[np.append(cut, len(low)) - 1] if len(low) else low
        if 4 * len(first) < min(2 * len(low), BLOCK // 8):
            return Bitmap(RUNS, np.stack([first, last], 1).astype(np.uint16))
        if 2 * len(low) < BLOCK // 8:
            return Bitmap(ARRAY, low.astype(np.uint16))
        bits = np.zeros(BLOCK, np.uint8)
        bits[low] = 1
        return Bitmap(BITS, np.packbits(bits))

    @staticmethod
    def load(data: bytes | None) -> Bitmap:
        if data is None:
            return Bitmap(ARRAY, np.zeros(0, np.uint16))
        kind, body = data[0], data[1:]
        got = np.frombuffer(body, np.uint8 if kind == BITS else np.uint16)
        return Bitmap(kind, got.reshape(-1, 2) if kind == RUNS else got)

    def dump(self) -> bytes:
        return bytes([self.kind]) + self.data.tobytes()

    def values(self) -> np.ndarray:
        if self.kind == ARRAY:
            return self.data.astype(np.int64)
        if self.kind == BITS:
            return np.flatnonzero(np.unpackbits(self.data))
        first, last = self.data[:, 0].astype(np.int64), self.data[:, 1].astype(np.int64)
        size = last - first + 1
        return np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())

    def has(self, v: np.ndarray) -> np.ndarray:
        if self.kind == BITS:
            return (self.data[v >> 3] >> (7 - (v & 7)).astype(np.uint8)) & 1 == 1
        if not len(self.data):
            return np.zeros(len(v), bool)
        if self.kind == ARRAY:
            at = np.minimum(np.searchsorted(self.data, v), len(self.data) - 1)
            return self.data[at] == v
        at = np.searchsorted(self.data[:, 0], v, "right") - 1
        return (at >= 0) & (self.data[at, 1] >= v)

    def and_not(self, other: Bitmap) -> np.ndarray:
        if self.kind == other.kind == BITS:
            return np.flatnonzero(np.unpackbits(self.data & ~other.data))
        v = self.values()
        return v[~other.has(v)]

    def both(self, other: Bitmap) -> np.ndarray:
        if self.kind == other.kind == BITS:
            return np.flatnonzero(np.unpackbits(self.data & other.data))
        if self.kind == BITS:
            self, other = other, self
        v = self.values()
        return v[other.has(v)]

    def rank(self, v: np.ndarray) -> np.ndarray:
        """How many positions of the set lie before each of its positions v."""
        if self.kind == BITS:
            return np.cumsum(np.unpackbits(self.data), dtype=np.int64)[v] - 1
        if self.kind == ARRAY:
            return np.searchsorted(self.data, v)
        first, last = self.data[:, 0].astype(np.int64), self.data[:, 1].astype(np.int64)
        before = np.append(0, np.cumsum(last - first + 1)[:-1])
        at = np.searchsorted(first, v, "right") - 1
        return before[at] + v - first[at]


def new_ordinals(keys: DataFrame, start: int = 0) -> DataFrame:
    """(key, ord) for distinct keys, from `start` on: the position in a partition plus the sizes of those before it."""
    placed = keys.withColumn("_n", F.monotonically_increasing_id())
    placed = written(placed.select("key", F.shiftright("_n", 33).alias("part"), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), "ordinals")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row per partition
    offsets = sizes.select("part", (F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("size") + start).alias("off"))
    return placed.join(F.broadcast(offsets), "part").select("key", (F.col("pos") + F.col("off")).alias("ord"))


def with_ordinals(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(key, ord) of the keys that are not known yet; their ordinals follow after the largest known one."""
    top = known.agg(F.max("ord")).first()[0]
    return new_ordinals(keys.join(known.select("key"), "key", "left_anti"), 0 if top is None else top + 1)


def _pack(n_values: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        row = {"snapshot": [pdf["snapshot"].iloc[0]], "block": [int(pdf["block"].iloc[0])], "bitmap": [Bitmap.of(pdf["low"].to_numpy(np.int64)).dump()]}
        for k in range(n_values):
            row[f"v{k}"] = [zlib.compress(pdf[f"v{k}"].to_numpy(np.int64).tobytes(), 1)]
        return pd.DataFrame(row)

    return pack


def _compare(n_values: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                old, new = Bitmap.load(r.bitmap), Bitmap.load(r.bitmap2)
                at = old.both(new)
                if len(at):
                    i, j = old.rank(at), new.rank(at)
                    diff = np.zeros(len(at), bool)
                    for k in range(n_values):
                        a = np.frombuffer(zlib.decompress(getattr(r, f"v{k}")), np.int64)
                        b = np.frombuffer(zlib.decompress(getattr(r, f"v{k}2")), np.int64)
                        diff |= a[i] != b[j]
                    at = at[diff]
                parts = [(new.and_not(old), "added"), (old.and_not(new), "removed"), (at, "changed")]
                low = [x for x, _ in parts]
                yield pd.DataFrame({"snapshot": r.snapshot, "ord": np.concatenate(low) + np.int64(r.block) * BLOCK, "change": np.repeat([c for _, c in parts], [len(x) for x in low])})

    return compare


class History:
    """Ordinals and blocks of the snapshots seen so far, in a folder all executors share.

    Every call of `add` appends its new ordinals and blocks under an id of its own and then lists
    the id, so a call that failed half-way leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, path: str, values: list[str]):
        self.spark, self.path, self.values = spark, path.rstrip("/"), values
        self.block_schema = "snapshot string, block bigint, bitmap binary, " + ", ".join(f"v{k} binary" for k in range(len(values)))

    def _done(self) -> list[tuple[str, str]]:
        """(id, last snapshot) of the calls so far, a handful a year."""
        if not exists(self.spark, f"{self.path}/calls"):
            return []
        return sorted((tuple(r) for r in self.spark.read.schema("id string, last string").parquet(f"{self.path}/calls").collect()), key=lambda x: x[1])

    def _read(self, what: str, schema: str, ids: list[str]) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{what}/{i}" for i in ids])

    def add(self, rows: DataFrame) -> DataFrame:
        """(snapshot, key, change) for new snapshots, given as rows (snapshot, key, BIGINT values), one row per snapshot and key."""
        rows = written(rows.select("snapshot", "key", *self.values), "snapshot-rows")
        done = self._done()
        ids, last = [i for i, _ in done], done[-1][1] if done else None
        snaps = [r[0] for r in rows.select("snapshot").distinct().orderBy("snapshot").collect()]  # one row per snapshot
        if last is not None and snaps and snaps[0] <= last:
            raise ValueError(f"snapshot {snaps[0]!r} is not later than {last!r}")
        call = uuid.uuid4().hex
        known = self._read("ordinals", "key string, ord bigint", ids)
        keys = rows.select("key").distinct()
        (with_ordinals(keys, known) if ids else new_ordinals(keys)).write.parquet(f"{self.path}/ordinals/{call}")
        ords = self._read("ordinals", "key string, ord bigint", [*ids, call])
        vs = [F.when(F.col(v).isNull(), F.lit(NULL)).otherwise(F.when(F.col(v) == NULL, F.lit(NULL + 1)).otherwise(F.col(v))).cast("bigint").alias(f"v{k}") for k, v in enumerate(self.values)]
        placed = rows.join(ords, "key").select("snapshot", F.floor(F.col("ord") / BLOCK).cast("bigint").alias("block"), F.pmod("ord", F.lit(BLOCK)).cast("bigint").alias("low"), *vs)
        placed.groupBy("snapshot", "block").applyInPandas(_pack(len(self.values)), self.block_schema).write.parquet(f"{self.path}/blocks/{call}")
        blocks = self._read("blocks", self.block_schema, [*ids[-1:], call])
        if snaps:
            self.spark.createDataFrame([(call, snaps[-1])], "id string, last string").coalesce(1).write.mode("append").parquet(f"{self.path}/calls")
        line = [last, *snaps] if last is not None else snaps
        steps = self.spark.createDataFrame(list(zip(line, line[1:])), "before string, snapshot string")
        n = len(self.values)
        old = blocks.withColumnRenamed("snapshot", "before").join(F.broadcast(steps), "before").drop("before")
        new = blocks.join(F.broadcast(steps), "snapshot").select("snapshot", "block", F.col("bitmap").alias("bitmap2"), *[F.col(f"v{k}").alias(f"v{k}2") for k in range(n)])
        found = old.join(new, ["snapshot", "block"], "full").mapInPandas(_compare(n), "snapshot string, ord bigint, change string")
        return found.join(broadcast_if_small(ords), "ord").select("snapshot", "key", "change")


def snapshot_changes(rows: DataFrame, values: list[str], path: str | None = None) -> DataFrame:
    """(snapshot, key, change) for rows (snapshot, key, BIGINT values), one row per snapshot and key.

    path: the folder of a History; snapshots kept there are known and only later ones are given.
    Without it a history is begun in the shared folder.
    """
    spark = rows.sparkSession
    return History(spark, path or scratch(spark, "history"), values).add(rows)


def catalog_rows(catalog: DataFrame) -> DataFrame:
    """The catalogue as (snapshot, key, price in cents, stock, status code), last delivery counting."""
    # distinct statuses are compared by a 64-bit hash of their trimmed lower-case text
    status = F.lower(F.trim("inventory_status"))
    rows = catalog.select(F.col("catalog_id").alias("snapshot"), norm_key(F.col("id")).alias("key"), micros_or_zero("ingested_at").alias("at"), "record_id", F.round(F.col("price") * 100).cast("bigint").alias("price"), F.col("stock_count").alias("stock"), F.when(F.col("inventory_status").isNotNull(), F.xxhash64(status)).alias("status"))
    return latest(rows.where("key is not null and snapshot is not null"), ["snapshot", "key"], "at", "record_id").drop("at", "record_id")


def micros_or_zero(c: str):
    return F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(0))


def catalog_changes(catalog: DataFrame, path: str | None = None) -> DataFrame:
    got = snapshot_changes(catalog_rows(catalog), ["price", "stock", "status"], path)
    return got.select(F.col("snapshot").alias("catalog_id"), F.col("key").alias("product_id"), "change")

"""Items that appear together (problem 5), counted by stripes.

Per basket each item has a stripe: the items after it. Within a partition stripes of the same item
are added up before anything is shuffled; then the arrays are merged by item (and part of the
neighbours, so that no item's stripe has to be one task's), and significance is the log-likelihood
ratio of the 2x2 table of baskets.

Exact pruning: a pair with at least `support` baskets consists of items with that many; and since
n(a,b) <= min(n(a), n(b)), a pair `lift` times as often as chance has no item in more than N / lift
baskets. The items left are broadcast if they are few, which saves work but changes no result.
Baskets of more than `WIDE` items are cut into ranges of left items that become rows of their own.

Defined cases: null and repeated items count once or not; baskets without items count in N; an
empty table gives nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.keys import latest, norm_key
from jsonloom.session import BROADCAST_ROWS, written

WIDE = 1000
PARTS = 16
#: Neighbour counts that a worker adds up before it hands its stripes on.
HELD = 500_000
STRIPE = "item string, part int, others array<string>, counts array<bigint>"


def _stripes(wanted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = wanted.value if wanted is not None else None
        held: dict[tuple[str, int], Counter] = {}
        n = 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"item": [k[0] for k in held], "part": [k[1] for k in held], "others": [list(c) for c in held.values()], "counts": [list(c.values()) for c in held.values()]})

        for pdf in batches:
            for xs, low in zip(pdf["xs"], pdf["low"]):
                xs = [x for x in xs if keep is None or x in keep] if low < 0 else list(xs)
                first, last = (0, len(xs)) if low < 0 else (low, min(low + WIDE, len(xs)))
                parts = [zlib.crc32(x.encode()) % PARTS for x in xs]
                for i in range(first, last):
                    if low >= 0 and keep is not None and xs[i] not in keep:
                        continue
                    for j in range(i + 1, len(xs)):
                        if low >= 0 and keep is not None and xs[j] not in keep:
                            continue
                        held.setdefault((xs[i], parts[j]), Counter())[xs[j]] += 1
                    n += len(xs) - i - 1
                    if n >= HELD and held:
                        yield flush()
                        held.clear()
                        n = 0
        if held:
            yield flush()

    return run


def _merge(support: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, Counter()

        def done() -> list[tuple[str, str, int]]:
            return [(now[0], b, n) for b, n in total.items() if n >= support] if now else []

        for pdf in batches:
            rows: list[tuple[str, str, int]] = []
            for item, part, others, counts in zip(pdf["item"], pdf["part"], pdf["others"], pdf["counts"]):
                if (item, part) != now:
                    rows += done()
                    now, total = (item, part), Counter()
                for b, n in zip(others, counts):
                    total[b] += int(n)
            yield pd.DataFrame(rows, columns=["a", "b", "n"])
        yield pd.DataFrame(done(), columns=["a", "b", "n"])

    return run


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def llr(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """Log-likelihood ratio G2 of a 2x2 table of counts."""
    k11, k12, k21, k22 = (k.cast("double") for k in (k11, k12, k21, k22))
    n = k11 + k12 + k21 + k22
    rows = _xlogx(k11 + k12) + _xlogx(k21 + k22)
    cols = _xlogx(k11 + k21) + _xlogx(k12 + k22)
    cells = _xlogx(k11) + _xlogx(k12) + _xlogx(k21) + _xlogx(k22)
    return F.greatest(F.lit(0.0), 2 * (cells + _xlogx(n) - rows - cols))


def pairs_together(baskets: DataFrame, items: str, support: int = 1, lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_all, lift, llr), item_a < item_b, of arrays of items, one row a basket."""
    xs = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))
    b = written(baskets.select(F.coalesce(xs, F.array().cast("array<string>")).alias("xs")), "baskets")
    total = b.count()
    singles = b.select(F.explode("xs").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= support) & (F.col("n") * lift <= total))
    singles = written(singles, "single-items")
    few = singles.select("item").limit(BROADCAST_ROWS + 1).collect()  # at most BROADCAST_ROWS + 1 rows
    wanted = baskets.sparkSession.sparkContext.broadcast({r[0] for r in few}) if len(few) <= BROADCAST_ROWS else None
    usual = b.where((F.size("xs") > 1) & (F.size("xs") <= WIDE)).select("xs", F.lit(-1).alias("low"))
    wide = b.where(F.size("xs") > WIDE).select("xs", F.explode(F.sequence(F.lit(0), F.size("xs") - 1, F.lit(WIDE))).alias("low")).repartition(F.xxhash64("xs", "low"))
    run = _stripes(wanted)
    stripes = usual.mapInPandas(run, STRIPE).unionByName(wide.mapInPandas(run, STRIPE))
    merged = stripes.repartition("item", "part").sortWithinPartitions("item", "part").mapInPandas(_merge(support), "a string, b string, n bigint")
    na, nb = singles.select(F.col("item").alias("a"), F.col("n").alias("n_a")), singles.select(F.col("item").alias("b"), F.col("n").alias("n_b"))
    if wanted is not None:
        na, nb = F.broadcast(na), F.broadcast(nb)
    got = merged.join(na, "a").join(nb, "b")
    k = F.col("n")
    return got.select(
        F.col("a").alias("item_a"), F.col("b").alias("item_b"), k.alias("n_ab"), "n_a", "n_b", F.lit(total).cast("bigint").alias("n_all"),
        (k * F.lit(float(total)) / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        llr(k, F.col("n_a") - k, F.col("n_b") - k, F.lit(total) - F.col("n_a") - F.col("n_b") + k).alias("llr"),
    ).where((F.col("n_ab").cast("double") * total) >= F.col("n_a") * F.col("n_b") * F.lit(float(lift)))


def order_baskets(orders: DataFrame) -> DataFrame:
    """The product keys of each order as it stands."""
    o = orders.where("order_id is not null").select("order_id", F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(0)).alias("seen"), "record_id", F.transform("items", lambda x: norm_key(x["product_id"])).alias("products"))
    return latest(o, ["order_id"], "seen", "record_id").select("products")

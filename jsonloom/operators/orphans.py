"""References to records that did not exist (problem 1).

A reference is (ref_field, period, record_id, ref_key, at); what exists is a set of validity
intervals (ref_field, ref_key, valid_from, valid_to), [from, to) in microseconds.

Plan: references are pre-aggregated per key and period, with their first and last instant (map-side
combine). The aggregates meet the merged intervals of their key: where one interval holds the whole
time of the aggregate none of its references is an orphan, where none touches it all of them are,
and only the others have to be looked at one by one. So the rows are joined with the aggregates that
are not settled as sound: those of heavy keys, of which there can be at most `HEAVY_PARTS`, are
broadcast after a count, the rest is joined by a shuffle on key and period (or broadcast too where
it is counted to be small); both parts are united. The counts per period come from the aggregates
and the counted rows of the unsettled ones.

Defined cases: a null or blank key is no reference; a reference whose instant is unreadable cannot
be resolved and is an orphan; overlapping or repeated validity rows of a key are merged; rows whose
validity starts nowhere (null) give nothing; an empty target makes every reference an orphan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.functions.keys import iso_micros, micros, norm_key
from jsonloom.session import BROADCAST_ROWS, broadcast_if_small, written

FOREVER = 2**63 - 1
#: A key is heavy if it has more than this fraction of all references: at most so many are.
HEAVY_PARTS = 500
KEY = ["ref_field", "ref_key"]
GROUP = [*KEY, "period"]


def merge_intervals(iv: DataFrame) -> DataFrame:
    """Overlapping and touching [valid_from, valid_to) of a key become one interval."""
    iv = iv.where(F.col("valid_from").isNotNull() & (F.col("valid_to") > F.col("valid_from")))
    iv = iv.groupBy(*KEY, "valid_from").agg(F.max("valid_to").alias("valid_to"))
    w = Window.partitionBy(*KEY).orderBy("valid_from")
    before = F.max("valid_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    iv = iv.withColumn("_new", F.when(before >= F.col("valid_from"), 0).otherwise(1))
    iv = iv.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return iv.groupBy(*KEY, "_island").agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")).drop("_island")


class Orphans:
    """The aggregates of references against intervals; rows and counts of orphans are read off them."""

    def __init__(self, refs: DataFrame, intervals: DataFrame, broadcast_rows: int = BROADCAST_ROWS):
        self.refs, self.bound = written(refs.select(*GROUP, "record_id", "at"), "references"), broadcast_rows
        groups = self.refs.groupBy(*GROUP).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("at").isNull()).alias("n_null"))
        self.intervals = written(merge_intervals(intervals), "validity")
        held, touched = (F.col("valid_from") <= F.col("lo")) & (F.col("valid_to") > F.col("hi")), (F.col("valid_from") <= F.col("hi")) & (F.col("valid_to") > F.col("lo"))
        # nulls of lo and hi (no readable instant) and missing intervals touch nothing
        met = groups.join(self.intervals, KEY, "left").groupBy(*GROUP, "n", "n_null").agg(F.max(F.coalesce(held, F.lit(False))).alias("held"), F.max(F.coalesce(touched, F.lit(False))).alias("touched"))
        state = F.when(F.col("held") & (F.col("n_null") == 0), "sound").when(~F.col("touched"), "orphan").otherwise("mixed")
        self.groups = written(met.select(*GROUP, "n", state.alias("state")), "reference-groups")

    def _open(self, states: list[str]) -> DataFrame:
        """The references of groups in those states, with the state; those of heavy keys apart."""
        refs, groups = self.refs, self.groups.where(F.col("state").isin(states)).select(*GROUP, "state")

        def of(r: DataFrame, g: DataFrame) -> DataFrame:
            g = g.toDF(*[f"_{c}" for c in GROUP], "state")
            return r.join(g, [F.col(k) == F.col(f"_{k}") for k in KEY] + [F.col("period").eqNullSafe(F.col("_period"))]).select(*r.columns, "state")

        if groups.limit(self.bound + 1).count() <= self.bound:
            return of(refs, F.broadcast(groups))
        total = self.groups.agg(F.sum("n")).first()[0] or 0
        of_key = self.groups.groupBy(*KEY).agg(F.sum("n").alias("n"))
        heavy = F.broadcast(of_key.where(F.col("n") > max(1000, total // HEAVY_PARTS)).select(*KEY))  # at most HEAVY_PARTS rows
        hot = of(refs.join(heavy, KEY, "left_semi"), broadcast_if_small(groups.join(heavy, KEY, "left_semi"), self.bound))
        return hot.unionByName(of(refs.join(heavy, KEY, "left_anti"), groups))

    def _orphans(self, states: list[str]) -> DataFrame:
        """Orphans in groups of those states; references of mixed groups are looked at one by one."""
        rows, keys = self._open(states), self.groups.where("state = 'mixed'").select(*KEY).distinct()
        iv = broadcast_if_small(self.intervals.join(broadcast_if_small(keys, self.bound), KEY, "left_semi"), self.bound)
        iv = iv.toDF(*[f"_{c}" for c in iv.columns])
        on = [F.col(k) == F.col(f"_{k}") for k in KEY] + [F.col("state") == "mixed", F.col("_valid_from") <= F.col("at"), F.col("at") < F.col("_valid_to")]
        return rows.join(iv, on, "left_anti").drop("state")

    def rows(self) -> DataFrame:
        """(ref_field, ref_key, period, record_id, at) of every orphan reference."""
        return self._orphans(["orphan", "mixed"])

    def report(self) -> DataFrame:
        """Per table field and period: references, orphans among them and distinct orphan keys."""
        by = ["ref_field", "period"]
        found = self._orphans(["mixed"]).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("bad"))
        zero = F.lit(0).cast("bigint")
        settled = self.groups.select(*by, "n", F.when(F.col("state") == "orphan", F.col("n")).otherwise(zero).alias("bad"), (F.col("state") == "orphan").cast("bigint").alias("keys"))
        counts = settled.unionByName(found.select(*by, zero.alias("n"), "bad", F.lit(1).cast("bigint").alias("keys")))
        return counts.groupBy(*by).agg(F.sum("n").alias("refs"), F.sum("bad").alias("orphans"), F.sum("keys").alias("orphan_keys"))


def find_orphans(refs: DataFrame, intervals: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The references for which no interval of their key holds their instant."""
    return Orphans(refs, intervals, broadcast_rows).rows()


def orphan_report(refs: DataFrame, intervals: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    return Orphans(refs, intervals, broadcast_rows).report()


# -- the references and targets of this data model ------------------------------------------------


def domain_references(orders: DataFrame, interactions: DataFrame) -> DataFrame:
    """Customer and sku references of orders, product references of interactions; once per row and key."""

    def at(time: str, day: str):
        return F.coalesce(iso_micros(F.col(time)), iso_micros(F.col(day))).alias("at")

    def ref(field: str, key):
        return F.struct(F.lit(field).alias("ref_field"), key.alias("ref_key"))

    # both kinds of an order come from one scan of it
    skus = F.array_distinct(F.transform("items", lambda x: norm_key(x["sku"])))
    of_items = F.coalesce(F.transform(skus, lambda k: ref("order_transactions.items.sku", k)), F.array().cast("array<struct<ref_field:string,ref_key:string>>"))
    keys = F.concat(F.array(ref("order_transactions.customer_id", norm_key(F.col("customer_id")))), of_items)
    o = orders.select(F.substring("transaction_date", 1, 7).alias("period"), "record_id", at("timestamp", "transaction_date"), F.explode(keys).alias("r"))
    i = interactions.select(F.substring("date", 1, 7).alias("period"), "record_id", at("timestamp", "date"), ref("customer_interactions.product_id", norm_key(F.col("product_id"))).alias("r"))
    return o.unionByName(i).where("r.ref_key is not null").select("r.ref_field", "period", "record_id", "r.ref_key", "at")


def profile_intervals(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.lit("order_transactions.customer_id").alias("ref_field"), norm_key(F.col("customer_id")).alias("ref_key"), micros(F.col("registered_at")).alias("valid_from"), F.coalesce(micros(F.col("deleted_at")), F.lit(FOREVER)).alias("valid_to")).where("ref_key is not null")


def catalog_intervals(catalog: DataFrame) -> DataFrame:
    """A product or sku of a snapshot exists from its last_updated to that of the next snapshot."""
    product = F.struct(F.lit("customer_interactions.product_id").alias("ref_field"), norm_key(F.col("id")).alias("ref_key"))
    skus = F.transform("variants", lambda v: F.struct(F.lit("order_transactions.items.sku").alias("ref_field"), norm_key(v["sku"]).alias("ref_key")))
    refs = F.concat(F.array(product), F.coalesce(skus, F.array().cast("array<struct<ref_field:string,ref_key:string>>")))
    rows = catalog.select(iso_micros(F.col("last_updated")).alias("valid_from"), refs.alias("refs")).where("valid_from is not null")
    # one row per snapshot: the ordering window runs over the snapshots' times only
    times = rows.select("valid_from").distinct()
    times = times.select("valid_from", F.coalesce(F.lead("valid_from").over(Window.partitionBy(F.lit(0)).orderBy("valid_from")), F.lit(FOREVER)).alias("valid_to"))
    rows = rows.join(broadcast_if_small(times, 10_000), "valid_from").select(F.explode("refs").alias("r"), "valid_from", "valid_to")
    return rows.where("r.ref_key is not null").select("r.ref_field", "r.ref_key", "valid_from", "valid_to")

"""The twenty questions of the reference corpus as DataFrame plans, over whole tables, and their SQL.

Orders and interactions are taken as they stand (the latest delivery of an id); keys are trimmed and
in upper case; money is summed in whole cents. Questions about one day are answered for every day.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jsonloom.functions.keys import iso_micros, latest, norm_key
from jsonloom.operators.intervals import within
from jsonloom.operators.nested import json_tables
from jsonloom.operators.nodes import json_nodes
from jsonloom.session import table

HOUR = 3_600_000_000


@dataclass
class Scope:
    """The records a question is about: a range of instants [start, end] in microseconds, values of fields, and order values.

    Fields are customer_id, product_id, order_id, status and type; keys are compared as keys, the others
    trimmed and without regard to case. A record without the field is not meant; a product is in an
    order if one of its lines has it. `without` names what records must not have; a record without the
    field stays. cents holds conditions (operator, whole cents).
    """

    start: int | None = None
    end: int | None = None
    fields: dict[str, str] = field(default_factory=dict)
    without: dict[str, str] = field(default_factory=dict)
    cents: list[tuple[str, int]] = field(default_factory=list)

    def rows(self, df: DataFrame) -> DataFrame:
        if self.start is not None:
            df = df.where(F.col("at") >= self.start)
        if self.end is not None:
            df = df.where(F.col("at") <= self.end)
        for name, v in self.fields.items():
            df = df.where(self._has(df, name, v))
        for name, v in self.without.items():
            df = df.where(~F.coalesce(self._has(df, name, v), F.lit(False)))
        if "cents" in df.columns:
            for op, n in self.cents:
                df = df.where(F.expr(f"cents {op} {n}"))
        return df

    @staticmethod
    def _has(df: DataFrame, name: str, v: str) -> Column:
        if name == "product_id" and "items" in df.columns:
            return F.exists("items", lambda x: norm_key(x["product_id"]) == v.strip().upper())
        if name not in df.columns:
            return F.lit(False)
        return norm_key(F.col(name)) == v.strip().upper() if name.endswith("_id") else F.lower(F.trim(name)) == v.strip().lower()


class Scoped(str):
    """A folder of tables whose records are narrowed to a scope wherever a plan reads them."""

    scope: Scope

    def __new__(cls, folder: str, scope: Scope):
        self = super().__new__(cls, folder)
        self.scope = scope
        return self


def _narrowed(sf: str, df: DataFrame) -> DataFrame:
    return sf.scope.rows(df) if isinstance(sf, Scoped) else df


def _needed(sf: str, cols: tuple[str, ...], possible: list[str]) -> list[str]:
    """The columns a plan asks for and those its scope looks at."""
    if not isinstance(sf, Scoped):
        return list(cols)
    s = sf.scope
    looked = [*(["at"] if s.start is not None or s.end is not None else []), *(["items"] if "product_id" in {**s.fields, **s.without} else []), *s.fields, *s.without, *(["cents"] if s.cents else [])]
    return list(dict.fromkeys([*cols, *[c for c in looked if c in possible]]))


def _seen() -> Column:
    return F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(0)).alias("_seen")


def orders(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    o = table(spark, sf, "order_transactions").where("order_id is not null").select("order_id", _seen(), "record_id", F.col("transaction_date").alias("day"), iso_micros(F.col("timestamp")).alias("at"), norm_key(F.col("customer_id")).alias("customer_id"), "items", F.round(F.col("total_amount") * 100).cast("bigint").alias("cents"), "status")
    got = latest(o.select("order_id", "_seen", "record_id", *[c for c in _needed(sf, cols, o.columns) if c != "order_id"]), ["order_id"], "_seen", "record_id")
    return _narrowed(sf, got).select("order_id", *cols)


def interactions(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    i = table(spark, sf, "customer_interactions").where("interaction_id is not null").select("interaction_id", _seen(), "record_id", F.col("date").alias("day"), iso_micros(F.col("timestamp")).alias("at"), "type", norm_key(F.col("customer_id")).alias("customer_id"), norm_key(F.col("product_id")).alias("product_id"))
    got = latest(i.select("interaction_id", "_seen", "record_id", *_needed(sf, cols, i.columns)), ["interaction_id"], "_seen", "record_id")
    return _narrowed(sf, got).select("interaction_id", *cols)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "product_catalog").select(iso_micros(F.col("last_updated")).alias("at"), "catalog_id", norm_key(F.col("id")).alias("product_id"))
    return _narrowed(sf, c)


def lines(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Order lines with their product key."""
    o = orders(spark, sf, *dict.fromkeys(["items", *cols]))
    got = o.select("order_id", *cols, F.explode("items").alias("x")).where("x is not null").select("order_id", *cols, norm_key(F.col("x.product_id")).alias("product_id"), "x.quantity", F.round(F.col("x.price") * 100).cast("bigint").alias("price"))
    if isinstance(sf, Scoped) and "product_id" in sf.scope.fields:
        got = got.where(F.col("product_id") == sf.scope.fields["product_id"].strip().upper())
    return got


def _money(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c / 100.0, 2)


def q01(spark, sf):
    """Total order value per day."""
    return orders(spark, sf, "day", "cents").groupBy("day").agg(_money(F.sum("cents")).alias("total"))


def q02(spark, sf):
    """Average order value per day."""
    return orders(spark, sf, "day", "cents").groupBy("day").agg(F.round(F.avg("cents") / 100.0, 6).alias("average"))


def q03(spark, sf):
    """All timestamps with their record type and ids, in order."""
    none = F.lit(None).cast("string")
    o = orders(spark, sf, "at", "customer_id").select("at", F.lit("order").alias("record_type"), F.col("order_id").alias("record"), "customer_id", none.alias("product_id"))
    i = interactions(spark, sf, "at", "type", "customer_id", "product_id").select("at", F.col("type").alias("record_type"), F.col("interaction_id").alias("record"), "customer_id", "product_id")
    c = catalog(spark, sf).select("at", F.lit("catalog").alias("record_type"), F.col("catalog_id").alias("record"), none.alias("customer_id"), none.alias("product_id")).distinct()
    return o.unionByName(i).unionByName(c).orderBy("at", "record_type", "record")


def q04(spark, sf):
    """Timeline of orders and interactions with customer and product, by day."""
    o = lines(spark, sf, "day", "at", "customer_id").select("day", "at", F.lit("order").alias("event"), F.col("order_id").alias("record"), "customer_id", "product_id").distinct()
    i = interactions(spark, sf, "day", "at", "type", "customer_id", "product_id").select("day", "at", F.col("type").alias("event"), F.col("interaction_id").alias("record"), "customer_id", "product_id")
    return o.unionByName(i)


def q05(spark, sf):
    """Every product id and the record types it appears in."""
    t = lambda df, k: df.where("product_id is not null").select("product_id", k.alias("record_type"))
    c = catalog(spark, sf).select("product_id")
    return t(lines(spark, sf), F.lit("order")).unionByName(t(interactions(spark, sf, "type", "product_id"), F.col("type"))).unionByName(t(c, F.lit("catalog"))).distinct()


def q06(spark, sf):
    """Every field named product_id, with path and value."""
    n = json_nodes(table(spark, sf, "json_chunks"), "chunk_no", "chunk_json")
    return n.where("member = 'product_id'").select("row_key", "path", "value")


def q07(spark, sf):
    """Each order's items, complete."""
    dec = lambda c: F.coalesce(F.round(c * 100).cast("bigint").cast("string"), F.lit(""))
    txt = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    one = lambda x: F.concat_ws("|", txt(x["product_id"]), txt(x["sku"]), txt(x["quantity"]), dec(x["price"]))
    return orders(spark, sf, "items").select("order_id", F.coalesce(F.size("items"), F.lit(0)).alias("n"), F.coalesce(F.concat_ws(";", F.transform("items", one)), F.lit("")).alias("contents")).where("n >= 0")


def q08(spark, sf):
    """All objects with both a customer_id and a product_id as direct members."""
    t = json_tables(table(spark, sf, "json_chunks"), "chunk_no", "chunk_json")
    has = F.from_json("node_json", "customer_id string, product_id string")
    keys = F.json_object_keys("node_json")
    return t.where(F.array_contains(keys, "customer_id") & F.array_contains(keys, "product_id")).select("row_key", "node_path", has["customer_id"].alias("customer_id"), has["product_id"].alias("product_id"))


def q09(spark, sf, least: float | None = 100):
    """Every number over 100 (or another bound, or none) with the path of the object around it."""
    n = json_nodes(table(spark, sf, "json_chunks"), "chunk_no", "chunk_json")
    return n.where("kind in ('int', 'float')").where("true" if least is None else F.col("number") > least).select("row_key", "path", F.col("parent_path").alias("object_path"), "number")


def q10(spark, sf):
    """For each timestamp the ids in the same object."""
    t = json_tables(table(spark, sf, "json_chunks"), "chunk_no", "chunk_json")
    f = F.from_json("node_json", "timestamp string, order_id string, customer_id string, product_id string")
    return t.withColumn("f", f).where("f.timestamp is not null").select("row_key", "node_path", F.col("f.timestamp").alias("at"), "f.order_id", "f.customer_id", "f.product_id")


def _contacts(spark, sf):
    o = orders(spark, sf, "at", "customer_id").select("customer_id", "at", F.lit("order").alias("kind"), F.col("order_id").alias("record"))
    i = interactions(spark, sf, "at", "type", "customer_id").select("customer_id", "at", F.col("type").alias("kind"), F.col("interaction_id").alias("record"))
    return o.unionByName(i).where("customer_id is not null")


def q11(spark, sf):
    """Each customer's contacts in order, the first one marked.

    Contacts are numbered within a day and the counts of the days before added, so that a customer
    with a large part of all rows is many small groups.
    """
    c = _contacts(spark, sf).withColumn("_day", F.floor(F.col("at") / (24 * HOUR)))
    days = c.groupBy("customer_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("customer_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(F.col("customer_id").alias("_c"), F.col("_day").alias("_d"), before.alias("_before"))
    c = c.withColumn("_k", F.row_number().over(Window.partitionBy("customer_id", "_day").orderBy("at", "kind", "record")))
    got = c.join(days, (F.col("customer_id") == F.col("_c")) & F.col("_day").eqNullSafe(F.col("_d")))
    nth = (F.col("_before") + F.col("_k")).cast("int")
    return got.select("customer_id", "at", "kind", "record", nth.alias("nth"), (nth == 1).alias("is_first"))


def q12(spark, sf):
    """Revenue per product and order status."""
    x = lines(spark, sf, "status").where("product_id is not null")
    return x.groupBy("product_id", "status").agg(_money(F.sum(F.col("quantity") * F.col("price"))).alias("revenue"))


def q13(spark, sf):
    """Orders with product ids and the customer's interactions of the same day (none: null)."""
    ids = lambda o: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("items", lambda x: norm_key(x["product_id"])))))
    o = orders(spark, sf, "day", "customer_id", "items").select("order_id", "day", "customer_id", ids("items").alias("products"))
    i = interactions(spark, sf, "day", "customer_id").select("day", "customer_id", "interaction_id")
    return o.join(i, ["day", "customer_id"], "left").select("order_id", "day", "customer_id", "products", "interaction_id")


def q14(spark, sf):
    """Customers who touched several products, with the kinds of contact."""
    o = lines(spark, sf, "customer_id").select("customer_id", "product_id", F.lit("order").alias("kind"))
    i = interactions(spark, sf, "type", "customer_id", "product_id").select("customer_id", "product_id", F.col("type").alias("kind"))
    g = o.unionByName(i).where("customer_id is not null and product_id is not null").groupBy("customer_id")
    return g.agg(F.countDistinct("product_id").alias("products"), F.concat_ws(",", F.array_sort(F.collect_set("kind"))).alias("kinds")).where("products > 1")


def q15(spark, sf):
    """Interactions within six hours of each order of the customer."""
    o = orders(spark, sf, "at", "customer_id").where("customer_id is not null")
    i = interactions(spark, sf, "at", "customer_id").where("customer_id is not null")
    got = within(o, i, "customer_id", "at", 6 * HOUR)
    return got.select("order_id", "interaction_id", "customer_id", F.col("gap").alias("micros_after"))


def q16(spark, sf):
    """Percentage of ordering customers who also left a review."""
    o = orders(spark, sf, "customer_id").where("customer_id is not null").select("customer_id").distinct()
    r = interactions(spark, sf, "type", "customer_id").where("type = 'product_review'").select("customer_id", F.lit(1).alias("hit")).distinct()
    return o.join(r, "customer_id", "left").agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("reviewers")).select("customers", "reviewers", F.round(100.0 * F.col("reviewers") / F.expr("nullif(customers, 0)"), 6).alias("percent"))


def q17(spark, sf):
    """Average hours from a customer's first order of a product to their first review of it after that."""
    o = lines(spark, sf, "at", "customer_id").groupBy("customer_id", "product_id").agg(F.min("at").alias("bought"))
    r = interactions(spark, sf, "at", "type", "customer_id", "product_id").where("type = 'product_review'").select("customer_id", "product_id", "at")
    j = o.join(r, ["customer_id", "product_id"]).where("at >= bought").groupBy("customer_id", "product_id", "bought").agg(F.min("at").alias("reviewed"))
    return j.groupBy("product_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("reviewed") - F.col("bought")) / HOUR, 4).alias("hours"))


def q18(spark, sf):
    """Orders, reviews and tickets per customer."""
    return _contacts(spark, sf).groupBy("customer_id").agg(F.count(F.lit(1)).alias("contacts"), F.count_if(F.col("kind") == "order").alias("orders"), F.count_if(F.col("kind") == "product_review").alias("reviews"), F.count_if(F.col("kind") == "support_ticket").alias("tickets"))


def q19(spark, sf):
    """Percentage of a product's interactions that are tickets."""
    i = interactions(spark, sf, "type", "product_id").where("product_id is not null")
    return i.groupBy("product_id").agg(F.count(F.lit(1)).alias("interactions"), F.round(100.0 * F.count_if(F.col("type") == "support_ticket") / F.count(F.lit(1)), 6).alias("percent"))


def q20(spark, sf):
    """Average order value per status."""
    return orders(spark, sf, "status", "cents").groupBy("status").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("cents") / 100.0, 6).alias("average"))


QUERIES = {f.__name__: f for f in (q01, q02, q03, q04, q05, q06, q07, q08, q09, q10, q11, q12, q13, q14, q15, q16, q17, q18, q19, q20)}

# -- SQL ---------------------------------------------------------------------------------------------

KEY = "nullif(upper(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"
AT = "epoch_us(cast(case when regexp_matches({0}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') then {0} else {0} || 'Z' end as timestamptz))"
BASE = f"""
with o as (
  select order_id, transaction_date as d, {AT.format('"timestamp"')} as ts, {KEY.format('customer_id')} as customer_id, items, cast(round(total_amount * 100) as bigint) as cents, status
  from (select *, row_number() over (partition by order_id order by ingested_at desc, record_id desc) rn from order_transactions where order_id is not null) where rn = 1),
i as (
  select interaction_id, "date" as d, {AT.format('"timestamp"')} as ts, type, {KEY.format('customer_id')} as customer_id, {KEY.format('product_id')} as product_id
  from (select *, row_number() over (partition by interaction_id order by ingested_at desc, record_id desc) rn from customer_interactions where interaction_id is not null) where rn = 1),
l as (select order_id, d, ts, customer_id, status, {KEY.format('x.product_id')} as product_id, x.quantity as quantity, cast(round(x.price * 100) as bigint) as price from (select *, unnest(items) x from o) where x is not null),
contacts as (
  select customer_id, ts, 'order' as kind, order_id as record from o where customer_id is not null
  union all select customer_id, ts, type, interaction_id from i where customer_id is not null)
"""
#: Documents of json_chunks: strings that hold JSON are opened, invalid ones left out (DuckDB lets a last comma pass).
DOCS = """
with raw as (select chunk_no, case when json_valid(chunk_json) and json_type(chunk_json) = 'VARCHAR' and json_valid(chunk_json ->> '$') then chunk_json ->> '$' else chunk_json end as js from json_chunks where chunk_json is not null and chunk_json <> '' and json_valid(chunk_json) and not regexp_matches(chunk_json, ',\\s*[}\\]]\\s*$')),
doc as (select chunk_no, js from raw where json_type(js) in ('OBJECT', 'ARRAY')),
t as materialized (select doc.chunk_no, j.id, j.parent, j.key, j.type, j.value, replace(regexp_replace(j.fullkey, '^\\$\\.?', ''), '"', '') as node from doc, lateral json_tree(doc.js) j)
"""
#: The kind of a node t.
KIND = "case when t.type in ('UBIGINT', 'BIGINT', 'HUGEINT') then 'int' when t.type = 'DOUBLE' then 'float' when t.type = 'VARCHAR' then 'string' when t.type = 'BOOLEAN' then 'bool' else lower(t.type) end"
#: From each node up over arrays to the nearest object, or the root.
CLIMB = DOCS.replace("with raw", "with recursive raw") + """,
up as (
  select chunk_no, id as node_id, parent as cur from t where parent is not null
  union all select up.chunk_no, up.node_id, t.parent from up join t on t.chunk_no = up.chunk_no and t.id = up.cur where t.type = 'ARRAY'),
above as (select up.chunk_no, up.node_id, max(case when p.type = 'OBJECT' then p.node end) as object_path from up left join t p on p.chunk_no = up.chunk_no and p.id = up.cur group by 1, 2)
"""

ORACLE = {
    "q01": BASE + "select d as day, round(sum(cents) / 100.0, 2) as total from o group by 1",
    "q02": BASE + "select d as day, round(avg(cents) / 100.0, 6) as average from o group by 1",
    "q03": BASE + f"select ts as at, 'order' as record_type, order_id as record, customer_id, null::varchar as product_id from o union all select ts, type, interaction_id, customer_id, product_id "
        f"from i union all select distinct {AT.format('last_updated')}, 'catalog', catalog_id, null, null from product_catalog",
    "q04": BASE + "select distinct d as day, ts as at, 'order' as event, order_id as record, customer_id, product_id from l union all select d, ts, type, interaction_id, customer_id, product_id "
        "from i",
    "q05": BASE + f"select product_id, 'order' as record_type from l where product_id is not null union select product_id, type from i where product_id is not null "
        f"union select {KEY.format('id')}, 'catalog' from product_catalog where {KEY.format('id')} is not null",
    "q06": DOCS + "select chunk_no as row_key, node as path, value ->> '$' as value from t where key = 'product_id' and not regexp_matches(node, '\\]$')",
    "q07": BASE + "select order_id, len(items)::int as n, coalesce(array_to_string([coalesce(x.product_id, '') || '|' || coalesce(x.sku, '') || '|' || coalesce(x.quantity::varchar, '') || '|' || coalesce(cast(round(x.price * 100) as bigint)::varchar, '') for x in items], ';'), '') as contents "
        "from o where items is not null union all select order_id, 0, '' from o where items is null",
    "q08": DOCS + "select chunk_no as row_key, node as node_path, value ->> '$.customer_id' as customer_id, value ->> '$.product_id' as product_id from t "
        "where type = 'OBJECT' and json_exists(value, '$.customer_id') and json_exists(value, '$.product_id')",
    "q09": CLIMB + "select t.chunk_no as row_key, t.node as path, coalesce(a.object_path, '') as object_path, cast(t.value as double) as number from t "
        "left join above a on a.chunk_no = t.chunk_no and a.node_id = t.id where t.type in ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') and cast(t.value as double) > 100",
    "q10": DOCS + "select chunk_no as row_key, node as node_path, value ->> '$.timestamp' as at, value ->> '$.order_id' as order_id, value ->> '$.customer_id' as customer_id, value ->> '$.product_id' as product_id "
        "from t where type = 'OBJECT' and (value ->> '$.timestamp') is not null",
    "q11": BASE + "select customer_id, ts as at, kind, record, row_number() over (partition by customer_id order by ts, kind, record)::int as nth, row_number() over (partition by customer_id order by ts, kind, record) = 1 as is_first "
        "from contacts",
    "q12": BASE + "select product_id, status, round(sum(quantity * price) / 100.0, 2) as revenue from l where product_id is not null group by 1, 2",
    "q13": BASE + f"select o.order_id, o.d as day, o.customer_id, coalesce((select string_agg(k, ',' order by k) from (select distinct {KEY.format('u.product_id')} k "
        f"from (select unnest(o.items) u)) where k is not null), '') as products, i.interaction_id from o left join i on o.d = i.d and o.customer_id = i.customer_id",
    "q14": BASE + "select customer_id, count(distinct product_id) as products, string_agg(distinct kind, ',' order by kind) as kinds from (select customer_id, product_id, 'order' as kind "
        "from l union all select customer_id, product_id, type from i) where customer_id is not null and product_id is not null "
        "group by 1 having count(distinct product_id) > 1",
    "q15": BASE + "select order_id, interaction_id, o.customer_id, i.ts - o.ts as micros_after from o join i on o.customer_id = i.customer_id and abs(i.ts - o.ts) <= 21600000000",
    "q16": BASE + "select count(*) as customers, count(r.customer_id) as reviewers, round(100.0 * count(r.customer_id) / nullif(count(*), 0), 6) as percent "
        "from (select distinct customer_id from o where customer_id is not null) b left join (select distinct customer_id "
        "from i where type = 'product_review') r using (customer_id)",
    "q17": BASE + "select product_id, count(*) as pairs, round(avg(reviewed - bought) / 3600000000, 4) as hours from (select b.customer_id, b.product_id, bought, min(i.ts) as reviewed "
        "from (select customer_id, product_id, min(ts) as bought from l group by 1, 2) b join i on i.customer_id = b.customer_id and i.product_id = b.product_id and i.type = 'product_review' and i.ts >= bought "
        "group by 1, 2, 3) group by 1",
    "q18": BASE + "select customer_id, count(*) as contacts, count(*) filter (kind = 'order') as orders, count(*) filter (kind = 'product_review') as reviews, count(*) filter (kind = 'support_ticket') as tickets "
        "from contacts group by 1",
    "q19": BASE + "select product_id, count(*) as interactions, round(100.0 * count(*) filter (type = 'support_ticket') / count(*), 6) as percent from i "
        "where product_id is not null group by 1",
    "q20": BASE + "select status, count(*) as orders, round(avg(cents) / 100.0, 6) as average from o group by 1",
}

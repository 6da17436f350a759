"""The queries pN_ of the general problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.operators import nested, orphans, rolling, snapshots
from jsonloom.plans.corpus import CLIMB, DOCS, KIND
from jsonloom.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    refs, iv = _references(spark, sf)
    return orphans.find_orphans(refs, iv).select("ref_field", "period", "record_id", "ref_key")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    refs, iv = _references(spark, sf)
    return orphans.orphan_report(refs, iv)


def _references(spark: SparkSession, sf: str):
    refs = orphans.domain_references(table(spark, sf, "order_transactions"), table(spark, sf, "customer_interactions"))
    iv = orphans.profile_intervals(table(spark, sf, "customer_profiles")).unionByName(orphans.catalog_intervals(table(spark, sf, "product_catalog")))
    return refs, iv


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        ("order_transactions", nested.struct_object_paths(table(spark, sf, "order_transactions"), "record_id", "items")),
        ("product_catalog", nested.struct_object_paths(table(spark, sf, "product_catalog"), "record_id", "variants")),
        ("json_chunks", nested.variant_nodes(table(spark, sf, "json_chunks"), "chunk_no", "chunk_json")),
    ]
    out = [df.select(F.lit(name).alias("source_table"), "row_key", "node_path", "parent_path") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def p2_schema(spark: SparkSession, sf: str) -> DataFrame:
    return nested.merged_schema(table(spark, sf, "json_chunks"), "chunk_json")


def p2_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The related tables of all three columns in one; node_json has the members, node_id is a key within a source_table."""
    parts = [
        ("order_transactions", nested.struct_tables(table(spark, sf, "order_transactions"), "record_id", "items")),
        ("product_catalog", nested.struct_tables(table(spark, sf, "product_catalog"), "record_id", "variants")),
        ("json_chunks", nested.json_tables(table(spark, sf, "json_chunks"), "chunk_no", "chunk_json")),
    ]
    out = [df.select(F.lit(name).alias("source_table"), "row_key", "table_path", "node_path", "parent_path", "ordinal", "depth", "node_id", "parent_id", "node_json") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def p2_items(spark: SparkSession, sf: str) -> DataFrame:
    return nested.struct_table(table(spark, sf, "order_transactions"), "record_id", "items", "items[]")


def p2_variants(spark: SparkSession, sf: str) -> DataFrame:
    return nested.struct_table(table(spark, sf, "product_catalog"), "record_id", "variants", "variants[]")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    daily = rolling.daily_amounts(table(spark, sf, "order_transactions"))
    got = rolling.trailing(daily, [7, 30], idle=7, least=90_000)
    return got.select(F.col("entity").alias("customer_id"), rolling.day_text("day").alias("activity_day"))


def p6_rolling(spark: SparkSession, sf: str) -> DataFrame:
    daily = rolling.daily_amounts(table(spark, sf, "order_transactions"))
    got = rolling.trailing(daily, [7, 30])
    avg = lambda w: F.round(F.col(f"cents_{w}") / (100.0 * w), 6).alias(f"avg_{w}")
    return got.select(F.col("entity").alias("customer_id"), rolling.day_text("day").alias("activity_day"), "cents_7", "orders_7", avg(7), "cents_30", "orders_30", avg(30))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.catalog_changes(table(spark, sf, "product_catalog"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_schema, p2_tables, p2_items, p2_variants, p6_found, p6_rolling, p7_found)}

# -- SQL ---------------------------------------------------------------------------------------------

_KEY = "nullif(upper(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"
# DuckDB reads the zone of a TIMESTAMPTZ cast; a text without one gets Z
_AT = "epoch_us(cast(case when regexp_matches({0}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') then {0} else {0} || 'Z' end as timestamptz))"

_P1 = f"""
with refs as (
  select distinct ref_field, period, record_id, ref_key, t_at from (
    select 'order_transactions.customer_id' ref_field, substr(transaction_date, 1, 7) period, record_id, {_KEY.format('customer_id')} ref_key, {_AT.format('"timestamp"')} t_at from order_transactions
    union all select 'order_transactions.items.sku', substr(transaction_date, 1, 7), record_id, {_KEY.format('x.sku')}, {_AT.format('"timestamp"')} from (select *, unnest(items) x from order_transactions)
    union all select 'customer_interactions.product_id', substr("date", 1, 7), record_id, {_KEY.format('product_id')}, {_AT.format('"timestamp"')} from customer_interactions)
  where ref_key is not null),
snaps as (select lu, lead(lu) over (order by lu) nxt from (select distinct {_AT.format('last_updated')} lu from product_catalog)),
cat as (select distinct {_KEY.format('id')} k, {_AT.format('last_updated')} lu, variants from product_catalog),
iv as (
  select 'order_transactions.customer_id' f, {_KEY.format('customer_id')} k, epoch_us(registered_at) a, epoch_us(deleted_at) b from customer_profiles
  union all select distinct 'customer_interactions.product_id', k, lu, nxt from cat join snaps using (lu)
  union all select distinct 'order_transactions.items.sku', {_KEY.format('v.sku')}, lu, nxt from (select lu, unnest(variants) v from cat) join snaps using (lu)),
orphan as (select r.* from refs r where not exists (select 1 from iv where f = r.ref_field and k = r.ref_key and a <= r.t_at and (b is null or b > r.t_at)))
"""

_DAILY = f"""
with o as (
  select {_KEY.format('customer_id')} c, cast(transaction_date as date) d, coalesce(cast(round(total_amount * 100) as bigint), 0) a from (
    select *, row_number() over (partition by order_id order by ingested_at desc, record_id desc) rn from order_transactions where order_id is not null)
  where rn = 1),
daily as (select c, d, sum(a) a, count(*) n from o where c is not null group by 1, 2),
spans as (select c, min(d) lo, max(d) hi from daily group by 1),
days as (select c, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) d from spans),
dense as (select c, d, coalesce(a, 0) a, coalesce(n, 0) n from days left join daily using (c, d)),
roll as (
  select c, d, sum(a) over w7 a7, sum(n) over w7 n7, sum(a) over w30 a30, sum(n) over w30 n30 from dense
  window w7 as (partition by c order by d rows between 6 preceding and current row), w30 as (partition by c order by d rows between 29 preceding and current row))
"""

ORACLE = {
    "p1_found": _P1 + "select ref_field, period, record_id, ref_key from orphan",
    "p1_report": _P1 + "select r.ref_field, r.period, count(*) as refs, count(o.record_id) as orphans, count(distinct o.ref_key) as orphan_keys from refs r "
        "left join orphan o on r.ref_field = o.ref_field and r.record_id = o.record_id and r.ref_key = o.ref_key group by 1, 2",
    "p2_found": CLIMB + """
select 'json_chunks' as source_table, t.chunk_no as row_key, t.node as node_path, coalesce(a.object_path, '') as parent_path from t left join above a on a.chunk_no = t.chunk_no and a.node_id = t.id where t.type = 'OBJECT' and t.parent is not null
union all select 'order_transactions', record_id, 'items[' || (k - 1) || ']', '' from (select record_id, unnest(items) x, generate_subscripts(items, 1) k from order_transactions) where x is not null
union all select 'product_catalog', record_id, 'variants[' || (k - 1) || ']', '' from (select record_id, unnest(variants) x, generate_subscripts(variants, 1) k from product_catalog) where x is not null""",
    "p2_schema": DOCS + f"""
, g as (select chunk_no, id, parent, key, type, node, regexp_replace(node, '\\[\\d+\\]', '[]', 'g') as path from t)
select distinct path as table_path, '' as member, 'object' as kind from g where type = 'OBJECT'
union select distinct p.path, t.key, {KIND} from g t join g p on p.chunk_no = t.chunk_no and p.id = t.parent where p.type = 'OBJECT'""",
    "p6_found": _DAILY + "select c as customer_id, strftime(d, '%Y-%m-%d') as activity_day from roll where n7 = 0 and a30 >= 90000",
    "p6_rolling": _DAILY + "select c as customer_id, strftime(d, '%Y-%m-%d') as activity_day, cast(a7 as bigint) as cents_7, cast(n7 as bigint) as orders_7, round(a7 / 700.0, 6) as avg_7, cast(a30 as bigint) as cents_30, cast(n30 as bigint) as orders_30, round(a30 / 3000.0, 6) as avg_30 "
        "from roll",
    "p7_found": f"""
with s as (
  select catalog_id, k, cast(round(price * 100) as bigint) p, stock_count n, lower(trim(inventory_status)) t from (
    select *, {_KEY.format('id')} k, row_number() over (partition by catalog_id, {_KEY.format('id')} order by ingested_at desc, record_id desc) rn from product_catalog)
  where rn = 1 and k is not null and catalog_id is not null),
steps as (select catalog_id a, lead(catalog_id) over (order by catalog_id) b from (select distinct catalog_id from s)),
old as (select steps.b c, s.* from s join steps on s.catalog_id = a where b is not null),
new as (select steps.b c, s.* from s join steps on s.catalog_id = b)
select coalesce(new.c, old.c) as catalog_id, coalesce(new.k, old.k) as product_id, case when old.k is null then 'added' when new.k is null then 'removed' else 'changed' end as change
from old full join new on old.c = new.c and old.k = new.k
where old.k is null or new.k is null or old.p is distinct from new.p or old.n is distinct from new.n or old.t is distinct from new.t""",
}

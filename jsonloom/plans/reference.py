"""Queries for the operators of the reference, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from jsonloom.functions import scalars as S
from jsonloom.functions.embedding import embed
from jsonloom.operators import archetypes as A
from jsonloom.operators import chunks as C
from jsonloom.operators import enrich as X
from jsonloom.operators import entities as E
from jsonloom.operators import nodes as N
from jsonloom.operators import relations as R
from jsonloom.operators import retrieval as V
from jsonloom.operators.summaries import group_summary
from jsonloom.plans import intent as I
from jsonloom.plans.ingest import identifiers, mentions
from jsonloom.plans.corpus import BASE, CLIMB, DOCS, KIND, interactions
from jsonloom.session import table
from jsonloom.sources.files import changed
from jsonloom.sources.files import object_roots as object_documents
from jsonloom.streaming.streams import event_windows, sessions

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _docs(spark: SparkSession, sf: str):
    return table(spark, sf, "json_chunks")


def _nodes(spark: SparkSession, sf: str):
    return N.json_nodes(_docs(spark, sf), "chunk_no", "chunk_json")


def _objects(spark: SparkSession, sf: str):
    return A.json_objects(_docs(spark, sf), "chunk_no", "chunk_json")


_SCALAR = "t.type not in ('OBJECT', 'ARRAY')"
_NAME = "case when regexp_matches(t.node, '\\]$') then regexp_extract(t.node, '([^.\\[\\]]*)(?:\\[\\d+\\])*$', 1) else t.key end"
_ANCESTORS = DOCS.replace("with raw", "with recursive raw") + """,
up as (select chunk_no, id as node_id, parent as cur from t where parent is not null union all select up.chunk_no, up.node_id, t.parent from up join t on t.chunk_no = up.chunk_no and t.id = up.cur where t.parent is not null),
deep as (select chunk_no, node_id, count(*) as depth from up group by 1, 2)
"""

# -- nodes and chunks ---------------------------------------------------------------------------------


@query(CLIMB + f"select t.chunk_no as row_key, t.node as path, coalesce(a.object_path, '') as parent_path, {KIND} as kind from t left join above a on a.chunk_no = t.chunk_no and a.node_id = t.id "
    f"where t.parent is not null")
def json_nodes(spark, sf):
    return _nodes(spark, sf).select("row_key", "path", "parent_path", "kind")


@query(DOCS + f"select t.chunk_no as row_key, {_NAME} as key_name, t.value ->> '$' as value_text, {KIND} as data_type, t.node as path from t where {_SCALAR} and t.parent is not null")
def key_value_pairs(spark, sf):
    return N.key_value_pairs(_nodes(spark, sf))


@query(_ANCESTORS + "select t.chunk_no as row_key, count(*) as nodes, max(depth)::int as max_depth, " + ", ".join(f"count(*) filter ({c}) as n_{k}" for k, c in (("array", "type = 'ARRAY'"), ("object", "type = 'OBJECT'"), ("string", "type = 'VARCHAR'"), ("int", "type in ('UBIGINT', 'BIGINT', 'HUGEINT')"), ("float", "type = 'DOUBLE'"), ("bool", "type = 'BOOLEAN'"), ("null", "type = 'NULL'"))) + " from t join deep d on d.chunk_no = t.chunk_no and d.node_id = t.id "
    "where t.parent is not null group by 1")
def structure_stats(spark, sf):
    return N.structure_stats(_nodes(spark, sf))


@query(DOCS + "select key as member, count(*) as n, count(distinct chunk_no) as documents, case when contains(key, '_') then split_part(key, '_', -1) end as suffix "
    "from t where parent is not null and not regexp_matches(node, '\\]$') group by 1")
def key_frequencies(spark, sf):
    return N.key_frequencies(_nodes(spark, sf))


@query(_ANCESTORS + f"select min(depth)::int as min_depth, max(depth)::int as max_depth, round(avg(depth), 6) as avg_depth from t join deep d on d.chunk_no = t.chunk_no and d.node_id = t.id "
    f"where {_SCALAR}")
def depth_stats(spark, sf):
    return N.depth_stats(_nodes(spark, sf))


@query()
def hybrid_chunks(spark, sf):
    return C.json_chunks(_docs(spark, sf), "chunk_no", "file_path", "chunk_json", most=None, context=False).select("row_key", "ordinal", "chunk_id", "path", "parent_path", "depth", "value_type", "chunk_json", "metadata")


@query(DOCS + f", f as (select chunk_no, file_path from json_chunks) select t.chunk_no as row_key, md5(regexp_replace(file_path, '^/+', '') || ':' || trim(replace(t.node, ' ', ''), '.')) as chunk_id, t.node as path, case {KIND} "
    f"when 'string' then 'str' when 'null' then 'NoneType' else {KIND} end as value_type from t join f using (chunk_no) "
    f"where {_SCALAR} and t.parent is not null union all select chunk_no, md5(regexp_replace(file_path, '^/+', '') || ':'), '', case json_type(js) "
    f"when 'VARCHAR' then 'str' when 'NULL' then 'NoneType' when 'BOOLEAN' then 'bool' when 'DOUBLE' then 'float' else 'int' end "
    f"from raw join f using (chunk_no) where json_type(js) not in ('OBJECT', 'ARRAY')")
def leaf_chunks(spark, sf):
    return C.leaf_chunks(_docs(spark, sf), "chunk_no", "file_path", "chunk_json", most=None, context=False).select("row_key", "chunk_id", "path", "value_type")


def _place_chunks(spark, sf):
    """Regions, nations and customers as chunks of one tree."""
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    none = F.lit(None).cast("string")
    of = lambda df, k, parent, name: df.select(k.alias("chunk_id"), parent.alias("parent_id"), F.concat(F.lit("p."), k).alias("path"), F.concat(F.lit('"'), F.col(name), F.lit('"')).alias("chunk_json"))
    rows = of(r, key("r", "r_regionkey"), none, "r_name").unionByName(of(n, key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name")).unionByName(of(c, key("c", "c_custkey"), key("n", "c_nationkey"), "c_name"))
    return rows.withColumns({"ordinal": F.substring("chunk_id", 2, 20).cast("int"), "depth": F.when(F.col("chunk_id").startswith("r"), 0).when(F.col("chunk_id").startswith("n"), 1).otherwise(2), "metadata": F.when(F.col("chunk_id").startswith("c"), F.lit("{}")).otherwise(F.lit('{"has_children": true}'))})


_PLACES = """
with k as (
  select 'r' || r_regionkey as id, null as parent, r_name as name, r_regionkey as o, 0 as depth from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey, 1 from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey, c_name, c_custkey, 2 from customer),
up as (
  select id, 1 as level, parent from k where parent is not null
  union all select k.id, 2, p.parent from k join k p on p.id = k.parent where p.parent is not null)
"""


@query(_PLACES + "select parent as chunk_id, level::int as level, id as child from up")
def chunk_children(spark, sf):
    return C.children(_place_chunks(spark, sf))


@query(_PLACES + "select id as chunk_id, level::int as level, parent from up")
def chunk_parents(spark, sf):
    return C.parents(_place_chunks(spark, sf))


@query(_PLACES + "select id as chunk_id, parent as parent_id, depth::int as depth, 'p.' || id as path, depth < 2 as has_children from k")
def chunk_hierarchy(spark, sf):
    return C.hierarchy_info(_place_chunks(spark, sf))


@query(
    _PLACES
    + """,
line as (
  select up.id, -level as place, k.o, 'Parent (p.' || k.id || '): "' || k.name || '"' as line from up join k on k.id = up.parent
  union all select id, 0, o, 'Current: "' || name || '"' from k
  union all select id, place, o, line from (
    select up.parent as id, level as place, k.o, 'Child (p.' || k.id || '): "' || k.name || '"' as line, row_number() over (partition by up.parent order by level, k.o, 'Child (p.' || k.id || '): "' || k.name || '"') as rn from up join k on k.id = up.id) where rn <= 10)
select id as chunk_id, string_agg(line, chr(10) order by place, o, line) as text from line group by 1"""
)
def chunk_context(spark, sf):
    return C.with_context(_place_chunks(spark, sf), most=10)


@query()
def enhanced_chunks(spark, sf):
    c = C.json_chunks(_docs(spark, sf), "chunk_no", "file_path", "chunk_json", "full", most=None, context=False)
    return X.enhance(c).select("row_key", "path", "tagged", X.shrunk(F.col("chunk_json")).alias("shown"), "path_depth", "path_kind", "path_category", F.col("numeric_meta.magnitude").alias("magnitude"), F.col("string_meta.length").alias("length"), F.col("temporal_meta.weekday").alias("weekday"))


@query()
def ancestor_context(spark, sf):
    return X.ancestor_context(_docs(spark, sf), "chunk_no", "chunk_json")


# -- scalar functions ---------------------------------------------------------------------------------

_CATEGORY = "case " + " ".join(f"when regexp_matches(s, '{p}') then '{c}'" for c, p in S.SEGMENT_ENDS) + " end"
_PATHKIND = "case " + " ".join(f"when regexp_matches(lower(t.node), '{'|'.join(ps)}') then '{c}'" for c, ps in S.PATH_PARTS) + " else 'unknown' end"


@query(DOCS + f"select t.chunk_no as row_key, t.node as path, trim(regexp_replace(regexp_replace(replace(t.node, ' ', ''), '\\[(\\d+)\\]', '.\\1', 'g'), '\\.{{2,}}', '.', 'g'), '.') as normal, {_PATHKIND} as kind, len(string_split(t.node, '.'))::int as depth, coalesce(list_filter(list_transform(string_split(lower(t.node), '.'), lambda s: {_CATEGORY}), lambda c: c is not null)[1], 'general') as category "
    f"from t where t.parent is not null")
def path_functions(spark, sf):
    p = F.col("path")
    return _nodes(spark, sf).select("row_key", "path", S.normalize_path(p).alias("normal"), S.path_kind(p).alias("kind"), S.path_depth(p).alias("depth"), S.path_category(p).alias("category"))


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(l_extendedprice - abs(l_extendedprice * 0.1), 4) as range_min, round(l_extendedprice + abs(l_extendedprice * 0.1), 4) as range_max, case "
    "when l_extendedprice = 0 then 0 else floor(log10(abs(l_extendedprice))) end::int as magnitude from lineitem")
def numeric_meta(spark, sf):
    m = S.numeric_meta(F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(m["range_min"], 4).alias("range_min"), F.round(m["range_max"], 4).alias("range_max"), m["magnitude"].alias("magnitude"))


@query("select doc_id, len(text)::int as length, coalesce(regexp_matches(text, '[0-9]'), false) as contains_numbers, coalesce(regexp_matches(text, 'https?://\\S+'), false) as contains_urls "
    "from documents")
def string_meta(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.string_meta(F.col("text")).alias("m")).select("doc_id", "m.length", *[F.coalesce(f"m.{c}", F.lit(False)).alias(c) for c in ("contains_numbers", "contains_urls")])


@query("with x as (select record_id, try_cast(replace(regexp_extract(timestamp, '\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}'), 'T', ' ') as timestamp) t, timestamp "
    "from order_transactions) select record_id, strftime(t, '%Y-%m-%d %H:%M:%S') as found, year(t)::int as year, month(t)::int as month, day(t)::int as day, (isodow(t) - 1)::int as weekday, case "
    "when regexp_matches(timestamp, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z') then 'ISO8601_UTC' when regexp_matches(timestamp, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?[+-]') then 'ISO8601_OFFSET' "
    "when regexp_matches(timestamp, '^\\d{4}-\\d{2}-\\d{2} ') then 'DATETIME' else 'DATE' end as layout from x")
def temporal_meta(spark, sf):
    t = F.col("timestamp")
    m = S.temporal_meta(t)
    return table(spark, sf, "order_transactions").select("record_id", F.date_format(m["timestamp"], "yyyy-MM-dd HH:mm:ss").alias("found"), m["year"].alias("year"), m["month"].alias("month"), m["day"].alias("day"), m["weekday"].alias("weekday"), S.timestamp_format(t).alias("layout"))


# -- archetypes ---------------------------------------------------------------------------------------


def _in(keys: list[str]) -> str:
    return f"list_has_any(ks, [{', '.join(repr(k) for k in keys)}])"


def _pt(cond: str, n: float) -> str:
    return f"(case when {cond} then {n} else 0.0 end)"


_OBJECTS = DOCS + f""",
kids as (select chunk_no, parent as id, list(key) as ks, count(*) as n, count(*) filter (type in ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE', 'BOOLEAN')) as num, bool_or(regexp_matches(value::varchar, '{A.TIMESTAMP}')) as stamped, bool_or(type in ('VARCHAR', 'UBIGINT', 'BIGINT', 'HUGEINT') and regexp_matches(value ->> '$', '{A.HTTP}')) as http from t where parent is not null group by 1, 2),
obj as (select t.chunk_no, t.node, coalesce(ks, []::varchar[]) as ks, coalesce(n, 0) as n, coalesce(num, 0) as num, coalesce(stamped, false) as stamped, coalesce(http, false) as http from t left join kids k on k.chunk_no = t.chunk_no and k.id = t.id where t.type = 'OBJECT')
"""
_SCORES = {
    "event_log": f"case when stamped then 0.4 + {_pt(_in(A.EVENT_KEYS[0]), 0.3)} + {_pt(_in(A.EVENT_KEYS[1]), 0.2)} else 0.0 end",
    "metric_data": f"(case when n > 0 then 0.3 * num / n else 0.0 end) + {_pt(_in(A.METRIC_KEYS[0]), 0.3)} + {_pt('stamped', 0.2)} + {_pt(_in(A.METRIC_KEYS[1]), 0.2)}",
    "api_response": f"0.3 * len(list_intersect(ks, [{', '.join(repr(k) for k in A.API_KEYS[0])}])) / 6.0 + {_pt('http', 0.4)} + {_pt(_in(A.API_KEYS[1]), 0.3)}",
    "state_machine": f"{_pt(_in(A.STATE_KEYS[0]), 0.4)} + {_pt(_in(A.STATE_KEYS[1]), 0.3)} + {_pt('stamped', 0.2)} + {_pt(_in(A.STATE_KEYS[2]), 0.1)}",
    "entity_collection": f"{_pt(_in(A.ENTITY_KEYS[0]), 0.3)} + {_pt(_in(A.ENTITY_KEYS[1]), 0.3)} + {_pt(_in(A.ENTITY_KEYS[2]), 0.2)} + {_pt(_in(A.ENTITY_KEYS[3]), 0.2)}",
    "transaction": f"{_pt(_in(A.DEAL_KEYS[0]), 0.4)} + {_pt('num > 0', 0.3)} + {_pt(_in(A.DEAL_KEYS[1]), 0.3)}",
}


@query(_OBJECTS + "select chunk_no as row_key, node as node_path, " + ", ".join(f"round(({s})::double, 6) as {n}" for n, s in _SCORES.items()) + " from obj")
def archetype_scores(spark, sf):
    return A.score_objects(_objects(spark, sf))


@query(_OBJECTS + ", long as (" + " union all ".join(f"select chunk_no, node, '{n}' as archetype, round(({s})::double, 6) as confidence from obj" for n, s in _SCORES.items()) + ") select chunk_no as row_key, node as node_path, row_number() over (partition by chunk_no, node order by confidence desc, archetype)::int as rank, archetype, confidence "
    "from long where confidence > 0")
def archetype_ranks(spark, sf):
    return A.rank_archetypes(_objects(spark, sf))


def _keys(p: str) -> str:
    return f"len(list_intersect(ks, [{', '.join(repr(k) for k in A.PATTERN_KEYS[p])}]))"


def _any(*names: str) -> str:
    return f"list_has_any(ks, [{', '.join(map(repr, names))}])"


_PATTERNS = {
    "record": f"{_keys('record')} / 9.0 * case when {_any('id', 'uuid')} and {_any('name', 'type', 'code')} then 2.0 when {_any('id', 'uuid')} and stable then 1.5 "
        f"when {_keys('record')} < 2 then 0.25 else 1.0 end",
    "event": f"{_keys('event')} / 13.0 * case when stamps > 0 and states > 0 then 2.0 when stamps > 0 then 1.5 else 1.0 end",
    "collection": "least(arrays / 2.0, 1.0)",
    "reference": "least(len(list_filter(ks, lambda k: regexp_matches(k, '(_id|_ref)$'))) / 2.0, 1.0)",
    "metric": f"{_keys('metric')} / 14.0 * case when numbers > 0 and {_any('quantity', 'stock', 'reserved', 'available')} then 2.0 when numbers > 0 then 1.5 "
        f"else 1.0 end",
    "state": f"{_keys('state')} / 9.0",
    "document": f"({_keys('document')} / 8.0 + case when depth > 2 then 1.0 else 0.0 end) / 2.0",
}
_DOC_PATTERNS = (
    _ANCESTORS
    + f""",
n as (select t.chunk_no, case when not regexp_matches(t.node, '\\]$') then t.key end as member, {KIND} as kind, t.value ->> '$' as v, d.depth from t join deep d on d.chunk_no = t.chunk_no and d.node_id = t.id where t.parent is not null),
m as (
  select chunk_no, member, count(*) filter (kind in ('int', 'float', 'bool') and member is not null) as numbers, count(*) filter (kind = 'string' and regexp_matches(v, '{A.TIMESTAMP}')) as stamps,
    count(*) filter (member in ('status', 'state') and kind not in ('object', 'array')) as states,
    count(distinct case when kind not in ('object', 'array') then kind || '=' || coalesce(v, '') end) = 1 as stable, bool_or(kind = 'array') as arr, max(depth) as depth
  from n group by 1, 2),
p as (
  select chunk_no, coalesce(list(member) filter (member is not null), []::varchar[]) as ks, sum(numbers) as numbers, sum(stamps) as stamps, sum(states) as states,
    coalesce(bool_or(stable) filter (member is not null), false) as stable, count(*) filter (member is not null and arr) as arrays, max(depth) as depth
  from m group by 1),
s as (select chunk_no as row_key, """
    + ", ".join(f"round(({c})::double, 6) as {n}" for n, c in _PATTERNS.items())
    + " from p)"
)


@query(_DOC_PATTERNS + " select * from s")
def document_patterns(spark, sf):
    return A.document_patterns(_nodes(spark, sf))


@query(_DOC_PATTERNS + " " + " union all ".join(f"select '{n}' as pattern, count(*) filter ({n} > 0.5) as documents from s" for n in _PATTERNS))
def pattern_counts(spark, sf):
    return A.pattern_counts(A.document_patterns(_nodes(spark, sf)))


_FORMAT = "case when regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z') then 'ISO8601_UTC' when regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?[+-]\\d{2}:\\d{2}') then 'ISO8601_OFFSET' when regexp_matches(v, '^\\d{10}') then 'UNIX_TIMESTAMP' when regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') then 'DATETIME' when regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}') then 'DATE' end"
_PICK = lambda cond, x: f"coalesce(string_agg(distinct {x}, ',' order by {x}) filter ({cond} and {x} is not null), '')"


@query(
    CLIMB
    + f""",
n as (select t.chunk_no, t.key as m, case when t.type not in ('OBJECT', 'ARRAY', 'NULL') then t.value ->> '$' end as v, split_part(regexp_replace(coalesce(a.object_path, ''), '\\[\\d+\\]', '', 'g'), '.', -1) as box
  from t left join above a on a.chunk_no = t.chunk_no and a.node_id = t.id where t.parent is not null and not regexp_matches(t.node, '\\]$')),
f as (select *, {_FORMAT} as fmt from n)
select chunk_no as row_key, {_PICK("regexp_matches(m, 'timestamp|created_at|date|time|datetime')", "fmt")} as timestamp_formats, {_PICK("m in ('event', 'event_type', 'action', 'type')", "v")} as event_types,
  {_PICK("m in ('unit', 'units')", "v")} as units, {_PICK("box in ('dimensions', 'tags', 'labels')", "m")} as dimensions,
  {_PICK("m in ('offset', 'limit', 'cursor', 'next_cursor', 'page', 'per_page', 'total_pages')", "m")} as paging,
  {_PICK("m in ('data', 'results', 'items', 'records', 'meta', 'metadata', '_metadata', 'error', 'errors', 'fault')", "m")} as response
from f group by 1"""
)
def metadata_profile(spark, sf):
    return A.metadata_profile(_nodes(spark, sf))


@query(CLIMB + "select t.chunk_no as row_key, nullif(coalesce(a.object_path, ''), '') as source, t.key as target, 'key-based' as type, t.node as path from t "
    "left join above a on a.chunk_no = t.chunk_no and a.node_id = t.id where t.parent is not null and not regexp_matches(t.node, '\\]$') and (t.key in ('id', 'ref', 'parent_id') or t.key like '%\\_id' escape '\\')")
def key_edges(spark, sf):
    return A.key_edges(_nodes(spark, sf))


@query(_DOC_PATTERNS + ", u as (" + " union all ".join(f"select row_key, '{n}' as pattern, {n} as confidence from s" for n in _PATTERNS) + ") select row_key, pattern, confidence from (select *, row_number() over (partition by row_key order by confidence desc, pattern) as rn "
    "from u) where rn = 1 and confidence > 0")
def best_patterns(spark, sf):
    return A.best_patterns(A.document_patterns(_nodes(spark, sf)))


@query(DOCS + "select chunk_no as row_key from raw where json_type(js) = 'OBJECT'")
def object_roots(spark, sf):
    return object_documents(_docs(spark, sf), "chunk_no", "chunk_json").select("row_key")


@query(DOCS + "select chunk_no as row_key, replace(regexp_replace(node, '\\[\\d+\\]', '', 'g'), '.', '_') as field, value ->> '$' as value from t where parent is not null and type = 'VARCHAR' and not regexp_matches(node, '\\]$') and (key = 'id' or ends_with(key, '_id'))")
def context_ids(spark, sf):
    return E.context_ids(_nodes(spark, sf))


@query(DOCS + "select a.chunk_no as row_key from (select distinct chunk_no from t where key = 'type' and value ->> '$' = 'product_review') a join (select distinct chunk_no "
    "from t where key = 'rating' and value ->> '$' = '5') b using (chunk_no)")
def key_value_search(spark, sf):
    """Documents with all key=value pairs of a question."""
    kv = N.key_value_pairs(_nodes(spark, sf))
    return N.with_pairs(kv, spark.range(1).select(I.key_values(F.lit("reviews with type=product_review rating=5")).alias("m")).first()["m"])


@query("select doc_id as filename from documents where doc_id % 2 = 0 or doc_id % 10 = 5")
def changed_files(spark, sf):
    """Texts as files, against a registry in which every second has another hash and some are missing."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("filename"), F.coalesce("text", F.lit("")).alias("t"))
    files = d.select("filename", F.sha2("t", 256).alias("file_hash"))
    old = F.when(F.col("filename") % 2 == 0, F.concat("t", F.lit("."))).otherwise(F.col("t"))
    return changed(files, d.where("filename % 10 <> 5").select(F.col("filename").alias("file_path"), F.sha2(old, 256).alias("file_hash"))).select("filename")


# -- entities and relations -----------------------------------------------------------------------------


@query(_OBJECTS + ", e as (select chunk_no, node, case when list_contains(ks, 'name') then 'person' when list_contains(ks, 'id') then 'identifier' when list_contains(ks, 'title') then 'document' "
    "when list_contains(ks, 'key') then 'reference' when list_contains(ks, 'uuid') then 'unique_id' when list_contains(ks, 'email') then 'contact' end as kind, n "
    "from obj) select chunk_no as row_key, node as node_path, kind as entity_type, n::int as n_members from e where kind is not null")
def entities(spark, sf):
    return E.track_entities(_objects(spark, sf)).select("row_key", "node_path", "entity_type", "n_members")


@query(
    _OBJECTS.replace("t.node, coalesce(ks", "t.node, t.id, coalesce(ks")
    + f""",
e as (select o.chunk_no, o.node, o.id, case when list_contains(ks, 'name') then 'name' when list_contains(ks, 'id') then 'id' when list_contains(ks, 'title') then 'title' when list_contains(ks, 'key') then 'key' when list_contains(ks, 'uuid') then 'uuid' when list_contains(ks, 'email') then 'email' end as k from obj o),
v as (select e.*, c.value ->> '$' as val, list_filter(string_split(e.node, '.'), lambda s: list_contains([{', '.join(map(repr, E.ROLES))}], s)) as roles from e join t c on c.chunk_no = e.chunk_no and c.parent = e.id and c.key = e.k where k is not null and c.type not in ('OBJECT', 'ARRAY')),
r as (select *, row_number() over (partition by chunk_no, val order by id desc) as rn, count(*) over (partition by chunk_no, val) as mentions from v where val is not null)
select chunk_no as row_key, val as entity_value, node as node_path, case k when 'name' then 'person' when 'id' then 'identifier' when 'title' then 'document' when 'key' then 'reference' when 'uuid' then 'unique_id' else 'contact' end as entity_type, roles[-1] as role, mentions from r where rn = 1"""
)
def entity_registry(spark, sf):
    return E.entity_registry(E.track_entities(_objects(spark, sf)))


@query(
    _OBJECTS.replace("t.node, coalesce(ks", "t.node, t.id, coalesce(ks")
    + """,
e as (select o.chunk_no, o.node, o.id, case when list_contains(ks, 'name') then 'name' when list_contains(ks, 'id') then 'id' when list_contains(ks, 'title') then 'title' when list_contains(ks, 'key') then 'key' when list_contains(ks, 'uuid') then 'uuid' when list_contains(ks, 'email') then 'email' end as k from obj o),
m as (select chunk_no, parent as id, key, value ->> '$' as v from t where type not in ('OBJECT', 'ARRAY'))
select e.chunk_no as row_key, e.node as node_path, case k when 'name' then 'person' when 'id' then 'identifier' when 'title' then 'document' when 'key' then 'reference' when 'uuid' then 'unique_id' else 'contact' end as entity_type,
  own.v as entity_id, coalesce(case when k = 'name' then own.v end, n.v, ti.v, own.v) as name
from e left join m own on own.chunk_no = e.chunk_no and own.id = e.id and own.key = e.k left join m n on n.chunk_no = e.chunk_no and n.id = e.id and n.key = 'name' and k <> 'name' left join m ti on ti.chunk_no = e.chunk_no and ti.id = e.id and ti.key = 'title' and k <> 'title'
where k is not null"""
)
def entity_names(spark, sf):
    return E.entities_with_names(E.track_entities(_objects(spark, sf)))


@query(
    DOCS
    + """,
s as (select chunk_no, value ->> '$' as v from t where parent is not null and type = 'VARCHAR'),
d as (select chunk_no, epoch_us(try_cast(case when not contains(v, ':') or regexp_matches(v, '(Z|[+-][0-9]{2}:?[0-9]{2})$') then v else v || 'Z' end as timestamptz)) as ts from s where regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})?)?$'))
select chunk_no as row_key, count(*) as times, min(ts) as first_at, max(ts) as last_at from d group by 1"""
)
def document_times(spark, sf):
    return R.string_times(_nodes(spark, sf)).groupBy("row_key").agg(F.count(F.lit(1)).alias("times"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query("select event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as ts from events")
def epoch_timestamps(spark, sf):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.date_format(S.epoch_timestamp(seconds), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(
    DOCS
    + """,
s as (select t.chunk_no, p.node as object_path, t.key as m, t.value ->> '$' as v from t join t p on p.chunk_no = t.chunk_no and p.id = t.parent where p.type = 'OBJECT' and t.type = 'VARCHAR')
select chunk_no as row_key, object_path, m as name_key, v as name from s where m in ('name', 'title', 'label', 'display_name', 'description')
union all select n.chunk_no, n.object_path, regexp_extract(n.m, '^(.+)_name$', 1) || '_id_display', n.v
from s n join (select distinct chunk_no, object_path, regexp_extract(m, '^(.+)_id$', 1) as stem from s where regexp_matches(m, '^.+_id$')) i on i.chunk_no = n.chunk_no and i.object_path = n.object_path and i.stem = regexp_extract(n.m, '^(.+)_name$', 1)
where regexp_matches(n.m, '^.+_name$')"""
)
def display_names(spark, sf):
    return E.display_names(_nodes(spark, sf))


@query(DOCS + ", s as (select distinct chunk_no, key, value ->> '$' as v from t where type = 'VARCHAR' and parent is not null and not regexp_matches(node, '\\]$')), "
    "own as (select v, max(chunk_no) as target from s where key = 'id' or key like '%\\_id' escape '\\' or regexp_matches(v, '^[A-Z]+-\\d+$') "
    "group by 1) select s.chunk_no as source, own.target, s.key as field, s.v as value from s join own using (v) where s.chunk_no <> own.target")
def rel_explicit(spark, sf):
    n = _nodes(spark, sf).where("kind = 'string' and member is not null")
    e = R.explicit_edges(n.select(F.col("row_key").alias("chunk"), F.col("row_key").alias("ordinal"), "member", "value"))
    m = F.from_json("metadata", "field string, value string")
    return e.select("source", "target", m["field"].alias("field"), m["value"].alias("value"))


_CLS = " union all ".join(f"select chunk_no, file_path, '{n}' as cls, {c} as w from json_chunks where regexp_matches(lower(chunk_json), '{'|'.join(ws)}')" for n, (ws, c) in R.CLASSES.items())
_REL = " union all ".join(f"select '{a}' as a, '{b}' as b" for a, b in R.RELATED)


@query(f"with c as ({_CLS}), r as ({_REL}), pairs as (select x.chunk_no, x.file_path, a, b, x.w, count(*) as links from c x join r on x.cls = a join c y on y.cls = b and y.file_path = x.file_path and y.chunk_no <> x.chunk_no "
    f"group by 1, 2, 3, 4, 5) select chunk_no as chunk, file_path, a as source_class, b as target_class, w::double as confidence, links "
    f"from pairs")
def rel_semantic(spark, sf):
    d = _docs(spark, sf).where("file_path is not null").select(F.col("chunk_no").alias("chunk"), "file_path", F.col("chunk_json").alias("text"))
    return R.semantic_links(d, ["file_path"]).withColumn("confidence", F.col("confidence").cast("double"))


@query(BASE + ", x as (select interaction_id as id, customer_id, product_id, ts from i where customer_id is not null and product_id is not null) select a.id as source, b.id as target, round(1 - floor(abs(a.ts - b.ts) / 86400000000) / 30.0, 6) as confidence "
    "from x a join x b on a.customer_id = b.customer_id and a.product_id = b.product_id and (a.ts < b.ts or (a.ts = b.ts and a.id < b.id)) and floor(abs(a.ts - b.ts) / 86400000000) <= 30")
def rel_temporal(spark, sf):
    i = interactions(spark, sf, "at", "customer_id", "product_id").where("customer_id is not null and product_id is not null")
    e = R.temporal_edges(i.withColumnRenamed("interaction_id", "chunk"), ["customer_id", "product_id"])
    return e.select("source", "target", "confidence")


@query()
def rel_reference(spark, sf):
    """Edges from each chunk to the chunks that hold the identifiers around it."""
    c = C.json_chunks(_docs(spark, sf), "chunk_no", "file_path", "chunk_json").withColumn("chunk_id", F.concat_ws("#", F.col("row_key").cast("string"), F.col("path")))
    return R.reference_edges(identifiers(c), mentions(c).drop("file_path"))


_EXPLICIT = ORACLE["rel_explicit"]


@query(f"""
select source::varchar as source, target::varchar as target, 'explicit' as relationship_type, 1.0::double as confidence from ({_EXPLICIT})
union all select source, target, 'temporal', confidence from ({ORACLE["rel_temporal"]})
union all select chunk::varchar, target_class || '#' || file_path, 'semantic', max(confidence)::double from ({ORACLE["rel_semantic"]}) group by 1, 2""")
def rel_all(spark, sf):
    n = _nodes(spark, sf).where("kind = 'string' and member is not null")
    key = F.col("row_key").cast("string")
    explicit = R.explicit_edges(n.select(key.alias("chunk"), F.col("row_key").alias("ordinal"), "member", "value"))
    i = interactions(spark, sf, "at", "customer_id", "product_id").where("customer_id is not null and product_id is not null")
    temporal = R.temporal_edges(i.withColumnRenamed("interaction_id", "chunk"), ["customer_id", "product_id"])
    return R.united(explicit, temporal, R.membership_edges(rel_semantic(spark, sf))).drop("metadata")


def _tree(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return c.select(key("c", "c_custkey").alias("source"), key("n", "c_nationkey").alias("target")).unionByName(n.select(key("n", "n_nationkey").alias("source"), key("r", "n_regionkey").alias("target")))


@query("select 'c' || c_custkey as seed, 'n' || c_nationkey as chunk, 1 as depth from customer union all select 'c' || c_custkey, 'r' || n_regionkey, 2 "
    "from customer join nation on c_nationkey = n_nationkey")
def graph_expand(spark, sf):
    e = _tree(spark, sf)
    return R.expand(e, e.select(F.col("source").alias("chunk")).where("source like 'c%'"))


_EDGES = "select 'c' || c_custkey as source, 'n' || c_nationkey as target from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation"


@query(f"with e as ({_EDGES}) select source as chunk, target as other, 'out' as direction, 'in_place' as relationship_type, 1.0::double as confidence from e "
    f"union all select target, source, 'in', 'in_place', 1.0 from e")
def edges_touching(spark, sf):
    e = _tree(spark, sf).withColumns({"relationship_type": F.lit("in_place"), "confidence": F.lit(1.0)})
    nodes = e.select(F.col("source").alias("chunk")).unionByName(e.select(F.col("target").alias("chunk")))
    return R.touching(e, nodes)


@query("with e as (select distinct l_orderkey as source, l_partkey as target, 'order_part' as relationship_type, round(1 - l_discount, 4) as confidence "
    "from lineitem) select * from (select *, row_number() over (partition by source order by confidence desc, target, relationship_type)::int as rank "
    "from e) where rank <= 3")
def top_edges(spark, sf):
    li = table(spark, sf, "lineitem")
    return R.top_edges(li.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("order_part").alias("relationship_type"), F.round(1 - F.col("l_discount"), 4).alias("confidence")).distinct())


@query("with d as (select order_id, status, row_number() over (partition by order_id order by ingested_at, record_id) as n from order_transactions where order_id is not null), "
    "s as (select order_id, status, lag(status) over (partition by order_id order by n) as before, n from d) select before as status_from, status as status_to, count(*) as n "
    "from s where n > 1 group by 1, 2")
def state_transitions(spark, sf):
    w = Window.partitionBy("order_id").orderBy("ingested_at", "record_id")
    d = table(spark, sf, "order_transactions").where("order_id is not null").withColumn("before", F.lag("status").over(w)).withColumn("k", F.row_number().over(w))
    return d.where("k > 1").groupBy(F.col("before").alias("status_from"), F.col("status").alias("status_to")).agg(F.count(F.lit(1)).alias("n"))


# -- vectors, summaries, context ------------------------------------------------------------------------


def _first_vector(spark, sf):
    return [float(x) for x in table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


_Q0 = "(select embedding from embeddings order by vec_id limit 1)"


@query(f"select vec_id, round(1 - list_cosine_similarity(embedding::double[], {_Q0}::double[]), 6) as distance from embeddings order by 1 - list_cosine_similarity(embedding::double[], {_Q0}::double[]), vec_id limit 10")
def knn_cosine(spark, sf):
    return V.nearest(table(spark, sf, "embeddings"), "embedding", _first_vector(spark, sf), 10, tie="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"select vec_id, round(list_distance(embedding::double[], {_Q0}::double[]), 6) as distance from embeddings order by list_distance(embedding::double[], {_Q0}::double[]), vec_id limit 10")
def knn_l2(spark, sf):
    return V.nearest(table(spark, sf, "embeddings"), "embedding", _first_vector(spark, sf), 10, "l2", tie="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"select vec_id, label, round(1 - list_cosine_similarity(embedding::double[], {_Q0}::double[]), 6) as distance from embeddings where label in (1, 2) order by 1 - list_cosine_similarity(embedding::double[], {_Q0}::double[]), vec_id limit 5")
def knn_filtered(spark, sf):
    return V.nearest(table(spark, sf, "embeddings"), "embedding", _first_vector(spark, sf), 5, where=F.col("label").isin(1, 2), tie="vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("with p as (select q.vec_id as q, v.vec_id as id, round(1 - list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as distance "
    "from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id) select q, id, round(distance, 6) as distance, rank "
    "from (select *, row_number() over (partition by q order by distance, id)::int as rank from p) where rank <= 3")
def knn_each(spark, sf):
    e = table(spark, sf, "embeddings")
    got = V.nearest_each(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    return got.select("q", "id", F.round("distance", 6).alias("distance"), "rank")


@query("with p as (select q.vec_id as q, v.vec_id as id, round(1 - list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as distance "
    "from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id) select q, id, round(1 - distance, 6) as relevance "
    "from (select *, row_number() over (partition by q order by distance, id) as rank from p) where rank <= 3 and distance <= 0.15")
def similar_pairs(spark, sf):
    """Of each row of the query set the three most similar others at 0.85 or above."""
    e = table(spark, sf, "embeddings")
    got = V.nearest_each(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    return got.where("distance <= 0.15").select("q", "id", F.round(1 - F.col("distance"), 6).alias("relevance"))


@query(f"with e as (select vec_id as source, lead(vec_id) over (partition by label order by vec_id) as target from embeddings), seed as (select vec_id, round(1 - list_cosine_similarity(embedding::double[], {_Q0}::double[]), 6) as distance, row_number() over (order by 1 - list_cosine_similarity(embedding::double[], {_Q0}::double[]), vec_id)::int as place "
    f"from embeddings qualify place <= 5) select vec_id as seed, vec_id as chunk, 'base' as role, place, distance from seed "
    f"union all select s.vec_id, a.target, 'related', 1, null from seed s join e a on a.source = s.vec_id where a.target is not null "
    f"union all select s.vec_id, b.target, 'related', 2, null from seed s join e a on a.source = s.vec_id join e b on b.source = a.target "
    f"where b.target is not null")
def hybrid_search(spark, sf):
    e = table(spark, sf, "embeddings")
    edges = e.select(F.col("vec_id").alias("source"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("target"), F.lit(1.0).alias("confidence")).where("target is not null")
    got = V.hybrid_search(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), edges, _first_vector(spark, sf), 5)
    return got.withColumn("distance", F.round("distance", 6))


@query(
    DOCS
    + """,
n as (select case when not regexp_matches(node, '\\]$') then key end as m, value ->> '$' as v from t where parent is not null and type in ('VARCHAR', 'UBIGINT', 'BIGINT', 'HUGEINT')),
s as (select *, case when regexp_matches(m, 'time|date') and v[5] = '-' then epoch_us(try_cast(case when not contains(v, ':') or regexp_matches(v, '(Z|[+-][0-9]{2}:?[0-9]{2})$') then v else v || 'Z' end as timestamptz)) end as ts from n)
select count(distinct (case when m = 'id' or ends_with(m, '_id') then v end)) as identifiers, min(ts) as first_at, max(ts) as last_at from s"""
)
def context_needs(spark, sf):
    return V.context_needs(_nodes(spark, sf))


def _records(spark, sf):
    i = table(spark, sf, "customer_interactions").select(F.to_json(F.struct("timestamp", "type")).alias("f"), F.col("rating").cast("double").alias("v"))
    e = table(spark, sf, "events").select(F.to_json(F.struct(F.col("event_type").alias("type"))).alias("f"), F.col("value").alias("v"))
    return i.unionByName(e)


_RECORDS = "with r as (select split_part(timestamp, 'T', 1) as k, 'date' as t, rating::double as v from customer_interactions where timestamp is not null union all select event_type, 'type', value from events)"


@query(_RECORDS + " select k as group_key, t as group_type, count(*) as n, coalesce(sum(cast(round(v * 100) as bigint)) / 100.0, 0) as total from r group by 1, 2")
def group_totals(spark, sf):
    return group_summary(_records(spark, sf), "f", "v")


@query(_RECORDS + " select k as group_key, t as group_type, count(*) as n, coalesce(sum(cast(round(v * 100) as bigint)) / 100.0, 0) as total from r group by rollup (t, k)")
def group_rollup(spark, sf):
    return group_summary(_records(spark, sf), "f", "v", rollup=True)


_TOKENS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))"


@query(f"""
with c as (select doc_id, source, {_TOKENS} as tokens, case when doc_id % 10 >= 8 then 0 when doc_id % 10 >= 6 then 1 else 2 end as band from documents where source is not null),
w as (select *, coalesce(sum(tokens) over (partition by source, band order by doc_id rows between unbounded preceding and 1 preceding), 0) as pre from c),
a as (select *, coalesce(max(case when band = 0 and pre < 1400 then pre + tokens end) over (partition by source), 0) as t0 from w),
b as (select *, coalesce(max(case when band = 1 and t0 + pre < 1800 then pre + tokens end) over (partition by source), 0) as t1 from a),
f as (select *, case band when 0 then pre when 1 then t0 + pre else t0 + t1 + pre end as before, case band when 0 then 1400 when 1 then 1800 else 2000 end as most from b)
select source, doc_id, band::int as band, tokens::bigint as tokens, before::bigint as tokens_before from f where before < most""")
def context_budget(spark, sf):
    d = table(spark, sf, "documents").where("source is not null").select("doc_id", "source", "text", ((F.col("doc_id") % 10) / 10.0).alias("score"), F.col("doc_id").alias("ordinal"))
    return V.assemble_context(d, ["source"], 2000).select("source", "doc_id", "band", F.col("tokens").cast("bigint"), F.col("tokens_before").cast("bigint"))


@query()
def embed_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", embed(F.col("text")).alias("embedding"))


# -- questions ------------------------------------------------------------------------------------------


def _texts(spark, sf):
    return table(spark, sf, "eval_items").select(F.concat(F.lit("e"), "item_id").alias("id"), "text").unionByName(table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")).where("text is not null")


_TEXTS = "with q as (select 'e' || item_id as id, lower(text) as low, text from eval_items where text is not null union all select 'd' || doc_id, lower(text), text from documents where text is not null)"
_BOTH = f"(regexp_matches(low, '{I.DATED}') and regexp_matches(low, '{I.VALUED}'))"
_HIT = {k: f"(regexp_matches(low, '{p}')" + (f" or {_BOTH})" if k in ("metric", "temporal") else ")") for k, p in I.INTENTS.items()}
_FIRST = lambda p, g=1: f"nullif(regexp_extract(low, '{p}', {g}), '')"


@query(_TEXTS + ", h as (select id, " + ", ".join(f"{c} as {k}" for k, c in _HIT.items()) + " from q) select id, case when temporal and metric then 'temporal_metric' "
    "when risk then 'risk' when temporal then 'temporal' when metric then 'metric' when relationship then 'relationship' "
    "else 'general' end as primary_intent, concat_ws(',', " + ", ".join(f"case when {k} then '{k}' end" for k in sorted(I.INTENTS)) + ") as intents from h")
def intents(spark, sf):
    return _texts(spark, sf).select("id", I.primary_intent(F.col("text")).alias("primary_intent"), F.concat_ws(",", I.intents(F.col("text"))).alias("intents"))


_METRIC = ", ".join(f"case when {_FIRST(p, 2)} not in ('the', 'a', 'an') then {_FIRST(p, 2)} end" for p in I.METRIC_NAMES)
_CMP = {k: "coalesce(" + ", ".join(_FIRST(f"{w} (\\d+)") for w in ws) + ")" for k, ws in I.COMPARISONS.items()}


@query(_TEXTS + ", m as (select id, case " + " ".join(f"when regexp_matches(low, '{p}') then '{k}'" for k, p in I.AGGREGATES.items()) + f" end as aggregation, coalesce({_METRIC}) as metric, " + ", ".join(f"{c} as c_{k}" for k, c in _CMP.items()) + " from q) select id, aggregation, metric, case " + " ".join(f"when c_{k} is not null then '{k}'" for k in _CMP) + " end as comparison, cast(coalesce(" + ", ".join(f"c_{k}" for k in _CMP) + ") as double) as number from m")
def metric_conditions(spark, sf):
    return _texts(spark, sf).select("id", I.metric_condition(F.col("text")).alias("m")).select("id", "m.*")


@query(_TEXTS + f", p as (select id, {_FIRST('page' + chr(92) + 's+(' + chr(92) + 'd+)')} as page, contains(low, 'next page') as nx, regexp_matches(low, 'prev(ious)? page') as pv, {_FIRST('show' + chr(92) + 's+(' + chr(92) + 'd+)' + chr(92) + 's+(results|items)')} as sh "
    f"from q) select id, case when page is not null then 'absolute' when nx or pv then 'relative' when sh is not null then 'limit' end as kind, case "
    f"when page is not null then page::bigint when nx then 1 when pv then -1 else sh::bigint end as number from p")
def paging(spark, sf):
    return _texts(spark, sf).select("id", I.paging(F.col("text")).alias("p")).select("id", "p.kind", "p.number")


@query("""
with d as (select record_id, cast(transaction_date as date) as d, record_id % 5 as form from order_transactions where transaction_date is not null),
r as (
  select record_id, form, case when form = 4 then make_date(2025, month(d), day(d)) else d end::timestamp as day from d where form <> 4 or strftime(d, '%m-%d') <> '02-29')
select record_id, strftime(case when form = 2 then day + interval 14 hour else day end, '%Y-%m-%d %H:%M:%S') as range_start,
  strftime(case when form = 1 then day + interval 9 hour + interval 30 minute + interval 59 second else day + interval 1 day - interval 1 second end, '%Y-%m-%d %H:%M:%S') as range_end from r""")
def time_ranges(spark, sf):
    """The range that a question about the day of each order names, in several spellings."""
    d = table(spark, sf, "order_transactions").where("transaction_date is not null").select("record_id", F.col("transaction_date").cast("date").alias("d"), (F.col("record_id") % 5).alias("form"))
    day = F.date_format("d", "MMMM d")
    year = F.date_format("d", "yyyy")
    text = F.when(F.col("form") == 0, F.concat(F.lit("What was sold on "), day, F.lit(", "), year)).when(F.col("form") == 1, F.concat(F.lit("orders before 9:30 on "), day, F.lit("th "), year)).when(F.col("form") == 2, F.concat(F.lit("orders after 2 pm, "), day, F.lit(" "), year)).when(F.col("form") == 3, F.concat(F.lit("page 3 of "), day, F.lit(", "), year)).otherwise(F.concat(F.lit("total of "), F.date_format("d", "d MMMM")))
    r = d.select("record_id", I.time_range(text, 2025).alias("r")).where("r is not null")
    second = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return r.select("record_id", second("r.start").alias("range_start"), second("r.end").alias("range_end"))


@query(f"""
with x as (select record_id, "timestamp" as s from order_transactions union all select -record_id, transaction_date from order_transactions)
select record_id, strftime(case when regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}Z$') then try_strptime(s, '%Y-%m-%dT%H:%M:%SZ') when regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}$') then try_strptime(s, '%Y-%m-%d %H:%M:%S') when regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then try_strptime(s, '%Y-%m-%d') end, '%Y-%m-%d %H:%M:%S') as parsed from x""")
def parsed_timestamps(spark, sf):
    o = table(spark, sf, "order_transactions")
    x = o.select("record_id", F.col("timestamp").alias("s")).unionByName(o.select((-F.col("record_id")).alias("record_id"), F.col("transaction_date").alias("s")))
    return x.select("record_id", F.date_format(S.parse_timestamp(F.col("s")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query()
def entity_references(spark, sf):
    return _texts(spark, sf).select("id", F.explode(I.entity_references(F.col("text"))).alias("key", "value"))


# -- streams as tables ----------------------------------------------------------------------------------


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n, sum(cast(round(value * 100) as bigint))::bigint as cents "
    "from events group by 1, 2")
def hourly_events(spark, sf):
    return event_windows(table(spark, sf, "events"))


@query("with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), "
    "b as (select *, sum(fresh) over (partition by user_id order by ts) as s from a) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as session_start, count(*) as n "
    "from b group by user_id, s")
def user_sessions(spark, sf):
    return sessions(table(spark, sf, "events"))



"""Deeply nested records as flat related tables (problem 2).

First a merged schema is inferred: which general paths (array positions written []) hold objects,
and with which members and kinds. Then every array level and member object is exploded into rows of
its table: the row's surrogate key, that of the object around it, and its position in the array.

Native arrays of structs are exploded by one Spark generator for each level of their type. JSON
texts are read as VARIANT, which holds rows of any shape, and exploded by one generator for each
level of the merged schema (`variant_nodes`): a generator hands on the rows that are done and opens
the others, so all levels are one pass over the texts without a shuffle, however many tables there
are. What VARIANT cannot hold (repeated member names, lone surrogates) and levels below `LEVELS`
are walked in Arrow batches. The members themselves (`json_tables`) are read in Arrow batches too,
because VARIANT keeps neither their order nor how numbers are written.

Defined cases: null, empty and invalid JSON gives nothing; a text that is one JSON string holding
JSON is opened once; scalars give nothing; null array elements are no objects but count as
positions; of repeated member names the last counts; empty objects are rows. A document of any
depth is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jsonloom.functions.jsonwalk import clean, document, kind, loads, walk
from jsonloom.session import spread

#: Distinct (member, kind) that a table may have before child_table refuses it.
MAX_SCHEMA = 100_000
FLUSH = 4096
LINKS = ["row_key", "node_id", "parent_id", "ordinal", "node_path"]


def _schema_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[str, str, str, int]] = set()
    for batch in batches:
        new = set()
        for text in batch.column(0).to_pylist():
            ok, doc = document(text)
            nodes = [("", "", None, None, doc, None, "")] + list(walk(doc)) if ok else []
            for _, _, ords, _, value, _, general in nodes:
                if isinstance(value, dict):
                    depth = len(ords or ())
                    new.add((general, "", "object", depth))
                    new.update((general, k, kind(v), depth) for k, v in value.items())
        new -= seen
        if len(seen) < MAX_SCHEMA:
            seen |= new
        rows = [(*map(clean, r[:3]), r[3]) for r in new]
        cols = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
        yield pa.record_batch([*cols, pa.array([r[3] for r in rows], pa.int32())], ["table_path", "member", "kind", "depth"])


def merged_schema(df: DataFrame, text: str) -> DataFrame:
    """(table_path, member, kind) of all documents: the merged schema, each entry once.

    Members '' with kind 'object' stand for the table itself, also if all its objects are empty.
    """
    return _schema(df, text).select("table_path", "member", "kind").distinct()


def _schema(df: DataFrame, text: str) -> DataFrame:
    return spread(df.select(F.col(text))).mapInArrow(_schema_batches, "table_path string, member string, kind string, depth int")


#: Levels exploded by generators; what lies deeper is walked.
LEVELS = 24
_END = "~end~"
_NODE = "struct<table_path:string,node_path:string,parent_path:string,ordinal:int,depth:int,open:boolean,v:variant>"


def _variant(text: Column) -> Column:
    """A whole strict JSON text as VARIANT, else null.

    try_parse_json lets pass what stands behind a value; between [ and a last element it does not.
    """
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))), "$", "array<variant>")
    told = ~text.contains(_END) & ~text.rlike(r"(?i)\\ud[89a-f]") & (F.size(whole) == 2)
    return F.when(told & (F.try_variant_get(F.get(whole, 1), "$", "string") == _END), F.get(whole, 0))


def opened(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_key, t, v) of the non-empty texts; a text that is one JSON string holding JSON is read as that."""
    d = spread(df.select(F.col(key).cast("bigint").alias("row_key"), F.col(text).alias("t"))).where("t <> ''").withColumn("v", _variant(F.col("t")))
    inner = F.when(F.col("t").rlike(r'^[ \t\n\r]*"'), F.try_variant_get("v", "$", "string"))
    return d.withColumn("i", inner).withColumn("iv", F.when(F.col("i").isNotNull(), _variant(F.col("i")))).select("row_key", "t", F.coalesce("iv", "v").alias("v"))


def _step(rows: DataFrame) -> DataFrame:
    """One level: open nodes give themselves, if they are objects, and what they hold; the others are handed on."""
    n = F.col("n")
    rows = rows.withColumn("m", F.when(n["open"], F.try_variant_get(n["v"], "$", "map<string,variant>")))
    rows = rows.withColumn("a", F.when(n["open"] & F.col("m").isNull(), F.try_variant_get(n["v"], "$", "array<variant>")))
    top, none, some = n["depth"] == 0, F.lit(None).cast("variant"), F.array().cast(f"array<{_NODE}>")

    def node(table: Column, path: Column, parent: Column, ordinal: Column, depth: Column, is_open: bool, v: Column) -> Column:
        return F.struct(table.alias("table_path"), path.alias("node_path"), parent.alias("parent_path"), ordinal.alias("ordinal"), depth.alias("depth"), F.lit(is_open).alias("open"), v.alias("v"))

    no = F.lit(None).cast("int")
    own = node(n["table_path"], n["node_path"], n["parent_path"], n["ordinal"], n["depth"], False, none)
    dotted = lambda p, k: F.when(top, k).otherwise(F.concat(p, F.lit("."), k))
    members = F.transform(F.map_entries("m"), lambda e: node(dotted(n["table_path"], e["key"]), dotted(n["node_path"], e["key"]), n["node_path"], no, n["depth"] + 1, True, e["value"]))
    at = lambda i: F.concat(n["node_path"], F.lit("["), i.cast("string"), F.lit("]"))
    elements = F.transform("a", lambda x, i: node(F.concat(n["table_path"], F.lit("[]")), at(i), n["parent_path"], i, n["depth"] + 1, True, x))
    told = F.when(F.col("m").isNotNull(), F.concat(F.array(own), members)).when(F.col("a").isNotNull(), elements).when(n["open"], some).otherwise(F.array(n))
    return rows.select("row_key", F.explode(told.cast(f"array<{_NODE}>")).alias("n"))


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects at and below nodes given as (row_key, table_path, node_path, parent_path, ordinal, depth, JSON)."""
    for batch in batches:
        rows = []
        for key, table, path, parent, ordinal, depth, text in zip(*(c.to_pylist() for c in batch.columns)):
            value = loads(text)
            if isinstance(value, dict):
                rows.append((key, table, path, parent, ordinal, depth))
            for p, up, ords, member, v, _, general in walk(value, path, parent, table, False):
                if isinstance(v, dict):
                    rows.append((key, clean(general), clean(p), clean(up), ords[-1] if member is None else None, depth + len(ords)))
        cols = list(zip(*rows)) or [()] * 6
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types)], ["row_key", "table_path", "node_path", "parent_path", "ordinal", "depth"])


def variant_nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_key, table_path, node_path, parent_path, ordinal, depth, node_id, parent_id) of each object below the root of the JSON texts."""
    deepest = _schema(df, text).agg(F.max("depth")).first()[0] or 0
    read = opened(df, key, text)
    names = ["row_key", "table_path", "node_path", "parent_path", "ordinal", "depth"]
    none, blank = F.lit(None).cast("int"), F.lit("")
    root = F.struct(blank.alias("table_path"), blank.alias("node_path"), blank.alias("parent_path"), none.alias("ordinal"), F.lit(0).alias("depth"), F.lit(True).alias("open"), F.col("v"))
    rows = read.where("v is not null").select("row_key", root.cast(_NODE).alias("n"))
    for _ in range(min(deepest, LEVELS) + 1):
        rows = _step(rows)
    got = rows.where("not n.open and n.depth > 0").select("row_key", *[F.col(f"n.{c}") for c in names[1:]])
    if deepest > LEVELS:
        left = rows.where("n.open").select("row_key", *[F.col(f"n.{c}") for c in names[1:]], F.to_json("n.v").alias("t"))
        got = got.unionByName(left.mapInArrow(_below, "row_key bigint, table_path string, node_path string, parent_path string, ordinal int, depth int"))
    rest = read.where("v is null").select(F.col("row_key"), F.col("t"))
    walked = rest.mapInArrow(_node_batches, "row_key bigint, table_path string, node_path string, parent_path string, ordinal int, depth int, node_json string")
    got = got.unionByName(walked.where("depth > 0").select(*names))
    return got.withColumn("node_id", _link("node_path")).withColumn("parent_id", _link("parent_path"))


def _values(array: list) -> list | None:
    """An array with null in place of its objects, which are rows of their own; None if it holds nothing else."""
    out: list = []
    todo, some = [(array, out)], False
    while todo:
        old, new = todo.pop()
        some |= not old
        for v in old:
            if isinstance(v, list):
                new.append([])
                todo.append((v, new[-1]))
            else:
                new.append(None if isinstance(v, dict) else v)
                some |= not isinstance(v, dict)
    return out if some else None


def _text(members: dict) -> str:
    """JSON of scalars and arrays of any depth."""
    try:
        return json.dumps(members, ensure_ascii=False)
    except RecursionError:
        pass
    end, comma = object(), object()
    parts = []
    for k, v in members.items():
        out, todo = [json.dumps(k, ensure_ascii=False) + ": "], [v]
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                out.append("[")
                todo.append(end)
                for n in range(len(x) - 1, -1, -1):
                    todo += [x[n], comma] if n else [x[n]]
            else:
                out.append("]" if x is end else ", " if x is comma else json.dumps(x, ensure_ascii=False))
        parts.append("".join(out))
    return "{" + ", ".join(parts) + "}"


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row_key", "table_path", "node_path", "parent_path", "ordinal", "depth", "node_json"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def flush(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[] for _ in names]
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ok, doc = document(text)
            nodes = [("", None, (0,), None, doc, None, "")] + list(walk(doc)) if ok else []
            for path, parent, ords, member, value, _, general in nodes:
                if isinstance(value, dict):
                    flat = {k: _values(v) if isinstance(v, list) else v for k, v in value.items() if not isinstance(v, dict)}
                    flat = {k: v for k, v in flat.items() if v is not None or value[k] is None}
                    up = None if parent is None else clean(parent)
                    rows.append((key, clean(general), clean(path), up, None if member is not None or up is None else ords[-1], 0 if up is None else len(ords), clean(_text(flat))))
            if len(rows) >= FLUSH:
                yield flush(rows)
                rows = []
        yield flush(rows)


def _link(path: str) -> Column:
    """The surrogate key of the object at a path of a row."""
    return F.when(F.col(path).isNotNull(), F.xxhash64("row_key", path))


def json_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """All related tables of the JSON texts in one DataFrame, told apart by table_path.

    node_id and parent_id are the surrogate keys (root objects have no parent), ordinal the position
    in the array around the node, node_json the node's own members: scalars, and arrays with null in
    place of objects.
    """
    nodes = spread(df.select(F.col(key).cast("bigint"), F.col(text))).mapInArrow(_node_batches, "row_key bigint, table_path string, node_path string, parent_path string, ordinal int, depth int, node_json string")
    return nodes.withColumn("node_id", _link("node_path")).withColumn("parent_id", _link("parent_path"))


def _free_names(members: list[str]) -> list[tuple[str, str]]:
    """Each member with the name of its column: members named like a link column get the suffix _value."""
    taken, out = {x.lower() for x in LINKS}, []
    for member in members:
        name = member
        while name.lower() in taken:
            name += "_value"
        taken.add(name.lower())
        out.append((member, name))
    return out


def child_table(tables: DataFrame, schema: DataFrame, table_path: str) -> DataFrame:
    """One related table with typed columns: those members that hold scalars or arrays somewhere.

    A member of one scalar kind gets its type (int and float give double), others are strings, arrays
    as JSON (null if they hold objects only). Members named like a link column get the suffix _value.
    """
    entries = schema.where(F.col("table_path") == table_path).limit(MAX_SCHEMA + 1).collect()  # one table's columns
    if len(entries) > MAX_SCHEMA:
        raise ValueError(f"more than {MAX_SCHEMA} schema entries for table {table_path!r}")
    kinds: dict[str, set[str]] = {}
    for r in entries:
        if r["kind"] != "object":
            kinds.setdefault(r["member"], set()).add(r["kind"])
    types = {frozenset(["int"]): T.LongType(), frozenset(["float"]): T.DoubleType(), frozenset(["int", "float"]): T.DoubleType(), frozenset(["bool"]): T.BooleanType()}
    fields = [T.StructField(m, types.get(frozenset(k - {"null"}), T.StringType())) for m, k in sorted(kinds.items())]
    rows = tables.where(F.col("table_path") == table_path)
    if not fields:
        return rows.select(*LINKS)
    parsed = rows.withColumn("_f", F.from_json("node_json", T.StructType(fields)))
    return parsed.select(*LINKS, *[F.col("_f").getField(m).alias(n) for m, n in _free_names([f.name for f in fields])])


def _has_struct(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) or isinstance(t, T.ArrayType) and _has_struct(t.elementType)


def _levels(df: DataFrame, key: str, column: str) -> list[tuple[str, int, T.StructType, DataFrame]]:
    """(table_path, depth, type, rows of row_key, v, node_path, parent_path and ordinal) of each struct level of a native column.

    The column's type is the merged schema; each array level is one Spark generator.
    """
    none = F.lit(None).cast("int")
    start = df.select(F.col(key).cast("bigint").alias("row_key"), F.col(column).alias("v"), F.lit(column).alias("node_path"), F.lit("").alias("parent_path"), none.alias("ordinal")).where("v is not null")
    out: list[tuple[str, int, T.StructType, DataFrame]] = []

    def level(rows: DataFrame, t: T.DataType, general: str, depth: int) -> None:
        if isinstance(t, T.ArrayType):
            rows = rows.select("row_key", "node_path", "parent_path", F.posexplode("v").alias("ordinal", "v")).where("v is not null")
            rows = rows.withColumn("node_path", F.concat("node_path", F.lit("["), F.col("ordinal").cast("string"), F.lit("]")))
            level(rows, t.elementType, f"{general}[]", depth + 1)
        elif isinstance(t, T.StructType):
            out.append((general, depth, t, rows))
            for f in t.fields:
                if _has_struct(f.dataType):
                    inner = rows.select("row_key", F.col("v").getField(f.name).alias("v"), F.concat("node_path", F.lit("." + f.name)).alias("node_path"), F.col("node_path").alias("parent_path"), none.alias("ordinal"))
                    level(inner.where("v is not null"), f.dataType, f"{general}.{f.name}", depth + 1)

    level(start, df.schema[column].dataType, column, 1)
    return out


def struct_object_paths(df: DataFrame, key: str, column: str) -> DataFrame:
    """(row_key, node_path, parent_path) of each struct in a native column, at any level of it."""
    out = [rows.select("row_key", "node_path", "parent_path") for _, _, _, rows in _levels(df, key, column)]
    got = out[0] if out else df.select(F.col(key).cast("bigint").alias("row_key"), F.lit(column).alias("node_path"), F.lit("").alias("parent_path")).limit(0)
    for x in out[1:]:
        got = got.unionByName(x)
    return got


def _members(t: T.StructType) -> list[str]:
    """The fields that are values of the struct itself, not rows of a table below it."""
    return [f.name for f in t.fields if not _has_struct(f.dataType)]


def struct_tables(df: DataFrame, key: str, column: str) -> DataFrame:
    """All related tables of a native column in one DataFrame, as json_tables gives them.

    The parent of a struct that no other is around is the row itself, with parent_path ''.
    """
    got = None
    for general, depth, t, rows in _levels(df, key, column):
        own = F.to_json(F.struct(*[F.col("v").getField(m).alias(m) for m in _members(t)]), {"ignoreNullFields": "false"}) if _members(t) else F.lit("{}")
        one = rows.select("row_key", F.lit(general).alias("table_path"), "node_path", "parent_path", "ordinal", F.lit(depth).alias("depth"), own.alias("node_json"))
        got = one if got is None else got.unionByName(one)
    if got is None:
        raise ValueError(f"no struct in column {column}")
    return got.withColumn("node_id", _link("node_path")).withColumn("parent_id", _link("parent_path"))


def struct_table(df: DataFrame, key: str, column: str, table_path: str) -> DataFrame:
    """One related table of a native column, with the struct's own fields as columns of their types."""
    t, rows = next((t, rows) for general, _, t, rows in _levels(df, key, column) if general == table_path)
    links = rows.select("row_key", _link("node_path").alias("node_id"), _link("parent_path").alias("parent_id"), "ordinal", "node_path", "v")
    return links.select(*LINKS, *[F.col("v").getField(m).alias(n) for m, n in _free_names(_members(t))])

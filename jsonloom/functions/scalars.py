"""Scalar functions on paths, timestamps and values, as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first_of(cases: list[tuple[Column, str]], other: str) -> Column:
    return reduce(lambda acc, c: F.when(c[0], c[1]).otherwise(acc), reversed(cases), F.lit(other))


def normalize_path(path: Column) -> Column:
    """No blanks, positions [i] as .i, no dots at the ends or doubled."""
    p = F.regexp_replace(F.replace(path, F.lit(" "), F.lit("")), r"\[(\d+)\]", ".$1")
    return F.regexp_replace(F.regexp_replace(p, r"\.{2,}", "."), r"^\.+|\.+$", "")


# Parts of a path that tell its kind, in the order in which they are tried.
PATH_PARTS = [("identifier", ["id", "key", "code"]), ("temporal", ["time", "date", "created", "updated"]), ("descriptor", ["name", "title", "label"]), ("metric", ["count", "total", "sum", "avg"])]
# Endings of a path segment that tell its category, in order.
SEGMENT_ENDS = [
    ("temporal", r"(date|time|timestamp|created|updated|deleted)(_at)?$"),
    ("identifier", r"(id|uuid|key|ref)$"),
    ("financial", r"(price|cost|amount|total|tax|discount)$"),
    ("quantity", r"(count|quantity|stock|inventory|available)$"),
    ("status", r"(status|state|condition|phase|stage)$"),
    ("contact", r"(email|phone|address|contact)$"),
    ("metadata", r"(type|category|tag|label|group)$"),
]


def path_kind(path: Column) -> Column:
    """Kind by substrings anywhere in the path, in lower case; 'unknown' if none."""
    return _first_of([(F.lower(path).rlike("|".join(parts)), kind) for kind, parts in PATH_PARTS], "unknown")


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def path_category(path: Column) -> Column:
    """Category of the first segment, from the left, whose ending is known; 'general' if none."""
    segment = lambda s: _first_of([(F.lower(s).rlike(p), c) for c, p in SEGMENT_ENDS], "")
    known = F.filter(F.transform(F.split(path, r"\."), segment), lambda c: c != "")
    return F.coalesce(F.get(known, 0), F.lit("general"))


_DAY, _CLOCK = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}"


def find_timestamp(text: Column) -> Column:
    """The first timestamp in a text as TIMESTAMP_NTZ, the zone left aside; null if there is none or it is invalid.

    Tried in order: date T time, date time, date with slashes and time, date.
    """
    shapes = [rf"{_DAY}T{_CLOCK}", rf"{_DAY} {_CLOCK}", rf"\d{{4}}/\d{{2}}/\d{{2}} {_CLOCK}", _DAY]
    hits = [F.regexp_extract(text, s, 0) for s in shapes]
    hit = F.coalesce(*[F.when(h != "", h) for h in hits])
    return F.replace(F.replace(hit, F.lit("/"), F.lit("-")), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")


def parse_timestamp(text: Column) -> Column:
    """A whole text in one of five layouts as TIMESTAMP_NTZ; day before month where both fit; else null."""
    layouts = [(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "yyyy-MM-dd'T'HH:mm:ss'Z'"), (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", "dd/MM/yyyy HH:mm:ss"), (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", "MM/dd/yyyy HH:mm:ss")]
    return F.coalesce(*[F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f))) for p, f in layouts]).cast("timestamp_ntz")


def epoch_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def numeric_meta(v: Column) -> Column:
    """A number with its 10 % range and order of magnitude (0 for 0)."""
    size = F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(F.when(v != 0, v))))).cast("int")
    return F.struct(v.alias("value_exact"), (v - F.abs(v * 0.1)).alias("range_min"), (v + F.abs(v * 0.1)).alias("range_max"), size.alias("magnitude"))


def string_meta(v: Column) -> Column:
    return F.struct(F.length(v).alias("length"), v.rlike(r"[0-9]").alias("contains_numbers"), v.rlike(r"https?://\S+").alias("contains_urls"))


def temporal_meta(v: Column) -> Column:
    """The timestamp found in a text with year, month, day and weekday (Monday 0)."""
    t = find_timestamp(v)
    return F.struct(t.alias("timestamp"), F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.weekday(t).alias("weekday"))


def timestamp_format(v: Column) -> Column:
    """The name of the layout a text begins with; null if none."""
    # Names of layouts and the beginnings they are known by, in order.
    shapes = [("ISO8601_UTC", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z"), ("ISO8601_OFFSET", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?[+-]\d{2}:\d{2}"), ("UNIX_TIMESTAMP", r"^\d{10}"), ("DATETIME", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"), ("DATE", r"^\d{4}-\d{2}-\d{2}")]
    return F.nullif(_first_of([(v.rlike(p), n) for n, p in shapes], ""), F.lit(""))


def group_type(fields: Column) -> Column:
    """What a JSON object is grouped by: date, type, category or default."""
    has = lambda k: F.array_contains(F.json_object_keys(fields), k)
    return _first_of([(has("timestamp") | has("date"), "date"), (has("type"), "type"), (has("category"), "category")], "default")


def group_key(fields: Column) -> Column:
    """The value a JSON object is grouped under: the day, the type or the category; 'unknown' without one."""
    get = lambda k: F.get_json_object(fields, f"$.{k}")
    kind = group_type(fields)
    value = F.when(kind == "date", F.split_part(F.coalesce(get("timestamp"), get("date")), F.lit("T"), F.lit(1))).when(kind == "type", get("type")).when(kind == "category", get("category"))
    return F.coalesce(value, F.lit("unknown"))

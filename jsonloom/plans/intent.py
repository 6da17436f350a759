"""What a question asks for, as Columns over its text: intents, time range, metric, paging, entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
ISO = r"\d{4}-\d{2}-\d{2}"
# The patterns of each intent, searched anywhere in the question in lower case.
PATTERNS = {
    "relationship": [
        r"related to",
        r"connected with",
        r"linked to",
        r"associated with",
        r"depends on",
        r"references",
        r"relationship between",
    ],
    "temporal": [
        r"(?:on\s+)?\d{4}-\d{2}-\d{2}",
        r"before\s+\d{1,2}:\d{2}\s*(?:am|pm)?",
        r"after\s+\d{1,2}:\d{2}\s*(?:am|pm)?",
        r"between\s+\d{1,2}:\d{2}\s*(?:am|pm)?\s+and\s+\d{1,2}:\d{2}\s*(?:am|pm)?",
        r"between\s+\d{4}-\d{2}-\d{2}\s+and\s+\d{4}-\d{2}-\d{2}",
        r"last\s+\d+\s+(?:day|week|month|year)s?",
        r"this (?:week|month|year)",
        r"since\s+\d{4}-\d{2}-\d{2}",
        r"before\s+\d{4}-\d{2}-\d{2}",
        r"after\s+\d{4}-\d{2}-\d{2}",
        r"on\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)",
        r"at\s+\d{1,2}(?::\d{2})?\s*(?:am|pm)?",
        r"from\s+\d{4}-\d{2}-\d{2}",
        r"to\s+\d{4}-\d{2}-\d{2}",
    ],
    "metric": [
        r"average|mean|avg",
        r"maximum|max|highest|peak",
        r"minimum|min|lowest|bottom",
        r"sum|total",
        r"count|number of|how many",
        r"greater than|more than|above",
        r"less than|under|below",
        r"equal to|exactly",
        r"value|amount|cost",
    ],
    "risk": [
        r"risk|danger|hazard",
        r"warning|alert|critical",
        r"threshold|limit|boundary",
        r"violation|breach|exceed",
        r"compliance|conform|adhere",
    ],
}
#: One expression for each intent, so that a question is searched four times and not thirty-five.
INTENTS = {k: "|".join(ps) for k, ps in PATTERNS.items()}
DATED = rf"{ISO}|({MONTHS})\s+\d{{1,2}}"
VALUED = "total|value|amount|sum|cost|price|revenue|sales"
AGGREGATES = {"average": "average|mean|avg", "maximum": "maximum|max|highest|peak", "minimum": "minimum|min|lowest|bottom", "sum": "sum|total", "count": "count|number of|how many"}
METRIC_NAMES = [r"(of|in|for)\s+(\w+)", r"()(\w+)\s+(values|measurements)", r"()(\w+)\s+(is|are|was|were)"]
COMPARISONS = {"greater_than": ["greater than", "more than", "above"], "less_than": ["less than", "under", "below"], "equals": ["equal to", "exactly"]}
ENTITY_PATTERNS = {"user": ["user", "by"], "status": ["status", "state"], "category": ["in", "category"]}


def _case(cases: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda acc, c: F.when(c[0], c[1]).otherwise(acc), reversed(cases), F.lit(None).cast("string"))


def intents(q: Column) -> Column:
    """All intents of a question, sorted; a date with a word of value is both temporal and metric."""
    low = F.lower(q)
    both = low.rlike(DATED) & low.rlike(VALUED)
    hit = {k: low.rlike(p) | both if k in ("metric", "temporal") else low.rlike(p) for k, p in INTENTS.items()}
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in sorted(hit.items())]))


def primary_intent(q: Column) -> Column:
    found = intents(q)
    has = lambda k: F.array_contains(found, k)
    cases = [(has("temporal") & has("metric"), F.lit("temporal_metric"))] + [(has(k), F.lit(k)) for k in ("risk", "temporal", "metric", "relationship")]
    return F.coalesce(_case(cases), F.lit("general"))


def time_range(q: Column, as_of_year: int) -> Column:
    """The day a question names by month and day, with before/after a clock time: (start, end) in TIMESTAMP_NTZ, or null.

    Months are tried in calendar order, the day after the month before the day in front of it; a day
    that does not exist is passed over, as is a clock time after 23:59 (no range then).
    """
    low = F.lower(q)
    # two searches find all spellings of a date; the first of each month is then tried
    ends = "(?:st|nd|rd|th)?"
    after = F.regexp_extract_all(low, F.lit(rf"((?:{MONTHS})\s+\d{{1,2}}{ends},?\s*(?:\d{{4}})?)"), 1)
    front = F.regexp_extract_all(low, F.lit(rf"(\d{{1,2}}{ends}\s+(?:{MONTHS}))"), 1)
    part = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))

    names = F.array(*map(F.lit, MONTHS.split("|")))
    this = F.lit(as_of_year)

    def firsts(hits: Column, month: Column, of) -> Column:
        """The dates that `of` gives of the first hit of each month."""
        told = F.transform(month, lambda m, i: F.when(F.array_position(month, m) == i + 1, of(F.get(hits, i), F.array_position(names, m).cast("int"))))
        return F.flatten(F.array_compact(told))

    def date(month: Column, place: int, year: Column, day: Column) -> Column:
        return F.struct(month.alias("m"), F.lit(place).alias("n"), F.try_make_timestamp(year, month, day.try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("day"))

    def later(h: Column, m: Column) -> Column:  # month and day, with the year behind them or without
        day = part(h, r"^[a-z]+\s+(\d{1,2})")
        return F.array(date(m, 0, F.coalesce(part(h, r"(\d{4})$").try_cast("int"), this), day), date(m, 1, this, day))

    months = F.transform(after, lambda h: F.regexp_extract(h, "^([a-z]+)", 1))
    before = F.transform(front, lambda h: F.regexp_extract(h, "([a-z]+)$", 1))
    tries = F.concat(firsts(after, months, later), firsts(front, before, lambda h, m: F.array(date(m, 2, this, part(h, r"^(\d{1,2})")))))
    some = (F.size(after) > 0) | (F.size(front) > 0)
    day = F.when(some, F.array_min(F.filter(tries, lambda x: x["day"].isNotNull()))["day"]).cast("timestamp_ntz")
    p = r"(before|after)\s+(\d{1,2}):?(\d{2})?\s*(am|pm)?"
    side, half = F.regexp_extract(low, p, 1), F.regexp_extract(low, p, 4)
    hour, minute = F.regexp_extract(low, p, 2).try_cast("int"), F.coalesce(F.regexp_extract(low, p, 3).try_cast("int"), F.lit(0))
    hour = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    ok = (side == "") | ((hour < 24) & (minute < 60))
    rest = lambda h, m: F.make_dt_interval(F.lit(0), h, m, F.lit(59.999999).cast("decimal(18,6)"))

    def around(day: Column) -> Column:
        start = F.when(side == "after", day + F.make_dt_interval(F.lit(0), hour, minute)).otherwise(day)
        end = F.when(side == "before", day + rest(hour, minute)).otherwise(day + rest(F.lit(23), F.lit(59)))
        return F.when(day.isNotNull() & ok, F.struct(start.alias("start"), end.alias("end")))

    return F.get(F.transform(F.array(day), around), 0)  # so that the day is searched for once


def relative_range(q: Column, as_of: str) -> Column:
    """The range of 'last N days/weeks/months/years' and 'this week/month/year' before a given day, or null."""
    low, day = F.lower(q), F.lit(as_of).cast("date")
    n = F.regexp_extract(low, r"last\s+(\d{1,4})\s+(day|week|month|year)", 1).try_cast("int")
    unit = F.regexp_extract(low, r"last\s+(\d{1,4})\s+(day|week|month|year)", 2)
    this = F.regexp_extract(low, r"this (week|month|year)", 1)
    start = F.when(unit == "day", F.date_sub(day, n)).when(unit == "week", F.date_sub(day, n * 7)).when(unit == "month", F.add_months(day, -n)).when(unit == "year", F.add_months(day, -12 * n)).when(this != "", F.when(this == "week", F.trunc(day, "week")).when(this == "month", F.trunc(day, "month")).otherwise(F.trunc(day, "year")))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), day.alias("end")))


def metric_condition(q: Column) -> Column:
    """(aggregation, metric, comparison, number); parts that are not there are null."""
    low = F.lower(q)
    agg = _case([(low.rlike(p), F.lit(k)) for k, p in AGGREGATES.items()])
    names = [F.regexp_extract(low, p, 2) for p in METRIC_NAMES]
    metric = F.coalesce(*[F.when((n != "") & ~n.isin("the", "a", "an"), n) for n in names])
    numbers = {k: F.coalesce(*[F.nullif(F.regexp_extract(low, rf"{w} (\d+)", 1), F.lit("")) for w in ws]) for k, ws in COMPARISONS.items()}
    kind = _case([(n.isNotNull(), F.lit(k)) for k, n in numbers.items()])
    return F.struct(agg.alias("aggregation"), metric.alias("metric"), kind.alias("comparison"), F.coalesce(*numbers.values()).cast("double").alias("number"))


def paging(q: Column) -> Column:
    """(kind, number): absolute page, relative next or previous (1 or -1), or limit; null if none."""
    low = F.lower(q)
    page, show = F.regexp_extract(low, r"page\s+(\d+)", 1), F.regexp_extract(low, r"show\s+(\d+)\s+(results|items)", 1)
    of = lambda k, n: F.struct(F.lit(k).alias("kind"), n.cast("bigint").alias("number"))
    return F.when(page != "", of("absolute", page)).when(low.contains("next page"), of("relative", F.lit(1))).when(low.rlike("prev(ious)? page"), of("relative", F.lit(-1))).when(show != "", of("limit", show))


def key_values(q: Column) -> Column:
    """The key=value words of a question as a map; the last of a key counts."""
    words = F.filter(F.split(F.trim(q), r"\s+"), lambda w: w.contains("="))
    return _last_wins(F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), F.substr(w, F.instr(w, "=") + 1).alias("value"))))


def _last_wins(entries: Column) -> Column:
    """A map of (key, value) entries in which the last of a key counts; one pass over the entries."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    # reversed, the first place of a key is its last one
    back = F.reverse(entries)
    names = F.transform(back, lambda e: e["key"])
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(back, (F.array_position(names, k) - 1).cast("int"))["value"]))


def entity_references(q: Column) -> Column:
    """Map of what a question refers to: key=value, key:value, #number as id, and user, status and category words."""
    low = F.lower(q)
    none = F.array().cast("array<struct<key:string,value:string>>")
    words = F.transform(F.filter(F.split(F.trim(q), r"\s+"), lambda w: w.contains("=")), lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), F.substr(w, F.instr(w, "=") + 1).alias("value")))
    typed = F.transform(F.regexp_extract_all(q, F.lit(r"(\w+:\w+)"), 1), lambda w: F.struct(F.substring_index(w, ":", 1).alias("key"), F.substr(w, F.instr(w, ":") + 1).alias("value")))
    one = lambda k, v: F.when(v.isNotNull(), F.array(F.struct(F.lit(k).alias("key"), v.alias("value")))).otherwise(none)
    number = F.nullif(F.regexp_extract(q, r"#(\d+)", 1), F.lit(""))
    parts = [words, typed, one("id", number)]
    for k, ws in ENTITY_PATTERNS.items():
        parts.append(one(k, F.coalesce(*[F.nullif(F.regexp_extract(low, rf"{w} (\w+)", 1), F.lit("")) for w in ws])))
    return _last_wins(F.concat(*parts))

"""From a question to a DataFrame plan, by a documented grammar instead of a language model.

A question is matched against the templates below, in order. What it says beside that narrows the
records before anything is computed of them:

- a time: a month and day with or without a clock time, ISO dates (on, since, from, after, before,
  to, between), 'last N days/weeks/months/years', 'this week/month/year';
- fields: key=value, key:value or key!=value with customer, product, order, status or type (with or without _id);
- an order value: above, more than, greater than, below, under, less than, equal to, exactly N, between M and N;
- 'by' or 'per' status, customer, day or month: an order value for each of them;
- 'page N' and 'show N results' choose rows of the answer, ordered by its columns.

A question that fits no template, or says something that its template cannot obey, gives a one-row
'unsupported' answer with the reason; nothing that was understood is left aside in silence.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.functions.keys import iso_micros
from jsonloom.plans import corpus, intent
from jsonloom.plans.corpus import Scope, Scoped

#: Rows of a page.
PAGE = 20
RECORDS = frozenset({"time", "fields", "value"})
#: Pattern of the question in lower case, the plan that answers it, and what it can obey.
TEMPLATES: list[tuple[str, Callable, frozenset[str]]] = [
    (r"percentage of customers.*review", corpus.q16, RECORDS),
    (r"percentage of its interactions.*ticket|what percentage.*ticket", corpus.q19, frozenset({"time", "fields"})),
    (r"compare .*orders|average order value (by|per) status", corpus.q20, RECORDS),
    (r"average time between purchase and review", corpus.q17, RECORDS),
    (r"how many interactions|interactions.* each customer", corpus.q18, RECORDS),
    (r"within (6|six) hours", corpus.q15, RECORDS),
    (r"same-day", corpus.q13, RECORDS),
    (r"multiple products", corpus.q14, RECORDS),
    (r"revenue", corpus.q12, RECORDS),
    (r"first interaction", corpus.q11, RECORDS),
    (r"for each timestamp", corpus.q10, frozenset({"time"})),
    (r"numerical value", corpus.q09, frozenset({"value"})),
    (r"both a customer_id and a product_id", corpus.q08, frozenset()),
    (r"items array", corpus.q07, RECORDS),
    (r"field named 'product_id'", corpus.q06, frozenset()),
    (r"every product id", corpus.q05, RECORDS),
    (r"timeline", corpus.q04, RECORDS),
    (r"all timestamps|chronological", corpus.q03, RECORDS),
]
FIELD = re.compile(r"\b(customer|product|order|status|type)(?:_id)?\s*(!=|=|:)\s*([\w\-.]+)", re.I)
BETWEEN = re.compile(r"\bbetween\s+\$?(\d+(?:\.\d+)?)\s+and\s+\$?(\d+(?:\.\d+)?)(?![\d\-:])")
GROUPS = {"status": F.col, "customer": lambda _: F.col("customer_id"), "day": F.col, "month": lambda _: F.substring("day", 1, 7)}
GROUP_BY = re.compile(r"\b(?:by|per|for each|grouped by)\s+(?:order\s+)?(status|customer|day|month)\b")
DAY = 86_400_000_000
OPERATORS = {"greater_than": ">", "less_than": "<", "equals": "="}


def plan(spark: SparkSession, question: str, as_of: str) -> dict:
    """What the question asks for, as plain values."""
    q = F.lit(question)
    year = int(as_of[:4])
    row = spark.range(1).select(intent.primary_intent(q).alias("intent"), intent.time_range(q, year).alias("range"), intent.relative_range(q, as_of).alias("relative"), intent.metric_condition(q).alias("metric"), intent.paging(q).alias("paging"), intent.entity_references(q).alias("entities")).first()
    return row.asDict(recursive=True)


def _micros(t: datetime.datetime) -> int:
    return round((t - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))


def _iso_range(question: str) -> tuple[int | None, int | None] | None:
    """The range that ISO dates in a question give, or None; whole days, both ends included."""
    low = question.lower()
    day = lambda m, k=1: _micros(datetime.datetime.fromisoformat(m[k]))
    try:
        if m := re.search(rf"between\s+({intent.ISO})\s+and\s+({intent.ISO})", low):
            return day(m), day(m, 2) + DAY - 1
        start = re.search(rf"(since|from|after)\s+({intent.ISO})", low)
        end = re.search(rf"(before|to|until)\s+({intent.ISO})", low)
        if start or end:
            a = day(start, 2) + (DAY if start[1] == "after" else 0) if start else None
            b = day(end, 2) - 1 + (0 if end[1] == "before" else DAY) if end else None
            return a, b
        if m := re.search(rf"({intent.ISO})", low):
            return day(m), day(m) + DAY - 1
    except ValueError:  # no such day
        return None
    return None


def scope_of(p: dict, question: str) -> Scope:
    """The records a planned question is about."""
    s = Scope()
    if p["range"]:
        s.start, s.end = _micros(p["range"]["start"]), _micros(p["range"]["end"])
    elif iso := _iso_range(question):
        s.start, s.end = iso
    elif p["relative"]:
        a, b = (datetime.datetime.combine(p["relative"][k], datetime.time()) for k in ("start", "end"))
        s.start, s.end = _micros(a), _micros(b) + DAY - 1
    for name, op, value in FIELD.findall(question):
        into = s.without if op == "!=" else s.fields
        into[name.lower() if name.lower() in ("status", "type") else f"{name.lower()}_id"] = value
    if m := BETWEEN.search(question.lower()):
        s.cents += [(">=", round(float(m[1]) * 100)), ("<=", round(float(m[2]) * 100))]
    if p["metric"]["comparison"]:
        s.cents.append((OPERATORS[p["metric"]["comparison"]], round(p["metric"]["number"] * 100)))
    return s


def _unsupported(spark: SparkSession, question: str, reason: str) -> DataFrame:
    return spark.createDataFrame([("unsupported", question, reason)], "status string, question string, reason string")


def ask(spark: SparkSession, sf: str, question: str, as_of: str | None = None) -> DataFrame:
    """The answer to a question about the tables in folder sf; as_of is the day that relative times and dates without a year go by (today)."""
    p = plan(spark, question, as_of or datetime.date.today().isoformat())
    low, scope = question.lower(), scope_of(p, question)
    found, obeys = next(((f, o) for pattern, f, o in TEMPLATES if re.search(pattern, low)), (None, RECORDS))
    said = {k for k, v in (("time", scope.start is not None or scope.end is not None), ("fields", scope.fields or scope.without), ("value", scope.cents)) if v}
    if found is None and not ("order" in low and p["metric"]["aggregation"]):
        return _unsupported(spark, question, "no template fits")
    if said - obeys:
        return _unsupported(spark, question, f"the answer cannot be narrowed by {', '.join(sorted(said - obeys))}")
    if p["paging"] and p["paging"]["kind"] == "relative":
        return _unsupported(spark, question, "which page comes next or before is not known; name it")
    if found is None:
        by = GROUP_BY.search(low)
        got = _order_metric(spark, Scoped(sf, scope), p["metric"]["aggregation"], by and by[1])
    elif found is corpus.q09:
        got = corpus.q09(spark, sf)
        if scope.cents:
            got = corpus.q09(spark, sf, None).where(" and ".join(f"number {op} {n / 100}" for op, n in scope.cents))
    elif found is corpus.q10:
        got, at = corpus.q10(spark, sf), iso_micros(F.col("at"))
        got = got.where(at >= scope.start) if scope.start is not None else got
        got = got.where(at <= scope.end) if scope.end is not None else got
    else:
        got = found(spark, Scoped(sf, scope) if said else sf)
    if p["paging"]:
        n = p["paging"]["number"]
        got = got.orderBy(*got.columns)
        got = got.limit(n) if p["paging"]["kind"] == "limit" else got.offset((n - 1) * PAGE).limit(PAGE)
    return got


def _order_metric(spark: SparkSession, sf: str, aggregation: str, by: str | None = None) -> DataFrame:
    """An aggregate of order values, of all orders or for each status, customer, day or month."""
    o = corpus.orders(spark, sf, "cents", "status", "customer_id", "day")
    agg = {"average": F.avg("cents") / 100, "maximum": F.max("cents") / 100, "minimum": F.min("cents") / 100, "sum": F.sum("cents") / 100, "count": F.count(F.lit(1)).cast("double")}[aggregation]
    columns = [F.count(F.lit(1)).alias("orders"), F.round(agg, 6).alias("value")]
    if by is None:
        return o.agg(F.lit(aggregation).alias("aggregation"), *columns)
    return o.groupBy(GROUPS[by](by).alias(by)).agg(F.lit(aggregation).alias("aggregation"), *columns)


def corpus_questions(path: str) -> list[str]:
    """The questions of a text file: lines that begin and end with a quotation mark."""
    with open(path, encoding="utf-8") as f:
        lines = [x.strip() for x in f]
    return [x.strip('"').strip(".,") for x in lines if len(x) > 1 and x[0] == x[-1] == '"']

import datetime
import random
import re

from pyspark.sql import functions as F

from jsonloom.plans import intent as I


def ask(spark, f, text):
    return spark.createDataFrame([(text,)], "q string").select(f(F.col("q"))).first()[0]


def test_intents(spark):
    p = lambda t: ask(spark, I.primary_intent, t)
    assert p("total of orders on march 3") == "temporal_metric" and p("a risk on 2024-01-01") == "risk"
    assert p("what depends on it") == "relationship" and p("hello") == "general" and p("a discount") == "metric" and p(None) == "general"


def test_time_range(spark):
    r = lambda t: (lambda x: x and (str(x["start"]), str(x["end"])))(ask(spark, lambda q: I.time_range(q, 2025), t))
    assert r("orders on March 18th, 2024") == ("2024-03-18 00:00:00", "2024-03-18 23:59:59.999999")
    assert r("3 april before 4:30 pm") == ("2025-04-03 00:00:00", "2025-04-03 16:30:59.999999")
    assert r("after 12 am on May 2") == ("2025-05-02 00:00:00", "2025-05-02 23:59:59.999999")
    assert r("February 30") is None and r("after 25 on march 3") is None and r("2024-01-01") is None and r(None) is None


def test_relative_range(spark):
    r = lambda t: (lambda x: x and (str(x["start"]), str(x["end"])))(ask(spark, lambda q: I.relative_range(q, "2025-03-12"), t))
    assert r("last 3 days") == ("2025-03-09", "2025-03-12") and r("this week")[0] == "2025-03-10" and r("last 2 months")[0] == "2025-01-12" and r("now") is None


def test_metric(spark):
    m = lambda t: tuple(ask(spark, I.metric_condition, t))
    assert m("average price of items above 100") == ("average", "items", "greater_than", 100.0)
    assert m("how many errors are under 5") == ("count", "errors", "less_than", 5.0) and m("x") == (None, None, None, None)


def test_paging_and_references(spark):
    assert tuple(ask(spark, I.paging, "page 3")) == ("absolute", 3) and tuple(ask(spark, I.paging, "prev page")) == ("relative", -1)
    assert tuple(ask(spark, I.paging, "show 20 items")) == ("limit", 20) and ask(spark, I.paging, "x") is None
    assert ask(spark, I.entity_references, "a=1 a=2 type:order #12 by ann") == {"a": "2", "type": "order", "id": "12", "user": "ann"}
    assert ask(spark, I.key_values, "k=v=w x y=") == {"k": "v=w", "y": ""}


def brute_references(text):
    got = {}
    for w in text.split():
        if "=" in w:
            k, v = w.split("=", 1)
            got[k] = v
    for k, v in re.findall(r"(\w+):(\w+)", text, re.A):
        got[k] = v
    if m := re.search(r"#(\d+)", text, re.A):
        got["id"] = m[1]
    low = text.lower()
    for k, words in {"user": ["user", "by"], "status": ["status", "state"], "category": ["in", "category"]}.items():
        for w in words:
            if m := re.search(rf"{w} (\w+)", low, re.A):
                got[k] = m[1]
                break
    return got


def test_references_of_many_texts(spark):
    rnd = random.Random(6)
    words = ["a=1", "a=2", "b=x=y", "=z", "type:order", "type:x", "#12", "#13", "by", "user", "ann", "status", "open", "state", "in", "category", "toys", "plain"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "q string").select("q", I.entity_references(F.col("q")).alias("m"))
    assert {r["q"]: dict(r["m"]) for r in df.collect()} == {t: brute_references(t) for t in texts}


def brute_range(text, year):
    months = "january february march april may june july august september october november december".split()
    low = text.lower()
    for m, name in enumerate(months, 1):
        for p, dated in ((rf"{name}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s*(\d{{4}})?", True), (rf"{name}\s+(\d{{1,2}})", False), (rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+{name}", False)):
            hit = re.search(p, low)
            if hit:
                try:
                    return str(datetime.date(int(hit[2]) if dated and hit[2] else year, m, int(hit[1])))
                except ValueError:
                    pass
    return None


def test_days_of_many_texts(spark):
    rnd = random.Random(7)
    words = ["march", "may", "february", "december", "1", "3rd", "29", "30", "31", "2024,", "2023", "18,", "orders", "of"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "q string").select("q", I.time_range(F.col("q"), 2025).alias("r"))
    got = {r["q"]: r["r"] and str(r["r"]["start"])[:10] for r in df.collect()}
    assert got == {t: brute_range(t, 2025) for t in texts} and len(set(got.values())) > 20

import random

import pytest

from jsonloom.operators import rolling as R


def brute(daily, windows):
    out = []
    for e in {d[0] for d in daily}:
        own = {d: (c, n) for x, d, c, n in daily if x == e}
        for day in range(min(own), max(own) + 1):
            row = [e, day]
            for w in windows:
                hit = [own[d] for d in range(day - w + 1, day + 1) if d in own]
                row += [sum(c for c, _ in hit), sum(n for _, n in hit)]
            out.append(tuple(row))
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    daily = list({(f"C{rnd.randint(0, 12)}", rnd.choice([rnd.randint(0, 40), rnd.randint(-200, 400)])): None for _ in range(150)})
    daily = [(e, d, rnd.randint(-5000, 90000), rnd.randint(1, 3)) for e, d in daily]
    got = R.trailing(spark.createDataFrame(daily, "entity string, day bigint, cents bigint, n bigint"), [7, 30])
    full = brute(daily, [7, 30])
    assert sorted(map(tuple, got.collect())) == full
    some = R.trailing(spark.createDataFrame(daily, "entity string, day bigint, cents bigint, n bigint"), [7, 30], idle=7, least=50000)
    assert sorted(map(tuple, some.collect())) == [r for r in full if r[3] == 0 and r[4] >= 50000]


def test_daily_amounts(spark, rows):
    cols = "record_id bigint, order_id string, customer_id string, timestamp string, transaction_date string, total_amount double, ingested_at timestamp, n int"
    import datetime as D

    t = lambda h: D.datetime(2025, 1, 9, h)
    data = [
        (1, "o1", " c1 ", "2025-01-02T23:30:00-02:00", "2025-01-03", 10.004, t(1), 0),  # replaced below
        (2, "o1", "C1", "2025-01-02T23:30:00-02:00", "2025-01-03", 20.0, t(2), 0),
        (3, "o2", "c1", "2025-01-03 10:00:00", "2025-01-03", None, t(1), 0),
        (4, "o3", " ", "2025-01-03", "2025-01-03", 5.0, t(1), 0),
        (5, "o4", "C2", "bad", "2025-01-04", 5.0, t(1), 0),
        (6, None, "C2", "2025-01-03", "2025-01-03", 5.0, t(1), 0),
        (7, "o5", "C2", "2025-01-04", "2025-01-04", -1.5, t(1), 0),
        (8, "o5", "C2", "2025-01-04", "2025-01-04", -2.5, t(1), 0),  # a tie: the larger record_id counts
    ]
    got = R.daily_amounts(spark.createDataFrame(data, cols))
    assert rows(got) == [("C1", 20091, 2000, 2), ("C2", 20092, 250, 2)]


def test_empty(spark):
    daily = spark.createDataFrame([], "entity string, day bigint, cents bigint, n bigint")
    assert R.trailing(daily, [7, 30]).count() == 0


def test_amounts_beyond_exact_sums_are_refused(spark):
    df = spark.createDataFrame([("a", 1, 2**53, 1), ("a", 2, 2**53, 1)], "entity string, day bigint, cents bigint, n bigint")
    with pytest.raises(Exception, match="beyond"):
        R.trailing(df, [7]).collect()

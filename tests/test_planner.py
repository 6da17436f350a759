import pytest

from jsonloom.plans import corpus
from jsonloom.plans.planner import ask

SF = "/root/testdata/sf0.001"


def orders(spark):
    return corpus.orders(spark, SF, "at", "day", "customer_id", "status", "cents").toPandas()


@pytest.fixture(scope="module")
def own(spark):
    return orders(spark)


def answer(spark, question):
    return ask(spark, SF, question, as_of="2024-12-31")


def words(day):
    months = "January February March April May June July August September October November December".split()
    return f"{months[int(day[5:7]) - 1]} {int(day[8:])}, {day[:4]}"


def test_a_day_narrows_the_rows(spark, own):
    day = own["day"].mode()[0]
    one = own[own["day"] == day]
    got = answer(spark, f"What was the total value of orders made on {words(day)}?").first()
    assert got["orders"] == len(one) > 0 and got["value"] == pytest.approx(one["cents"].sum() / 100)
    every, some = (answer(spark, q) for q in ("Revenue per product", f"Revenue per product on {words(day)}"))
    total = lambda df: df.toPandas()["revenue"].sum()
    assert 0 < some.count() < every.count() and total(some) < total(every)
    assert answer(spark, f"Revenue per product on {day}").count() == some.count()
    assert answer(spark, f"Compare orders by average value between {day} and {day}").toPandas()["orders"].sum() == len(one)


def test_ranges(spark, own):
    days = sorted(own["day"])
    mid = days[len(days) // 2]
    n = lambda q: answer(spark, q).first()["orders"]
    assert n(f"count of orders since {mid}") == (own["day"] >= mid).sum()
    assert n(f"count of orders before {mid}") == (own["day"] < mid).sum()
    got = ask(spark, SF, "count of orders in the last 10 days", as_of=mid).first()["orders"]
    assert got > 0 and got < len(own)


def test_fields_and_values(spark, own):
    customer = own["customer_id"].dropna().mode()[0]
    got = answer(spark, f"How many interactions did each customer have? customer={customer.lower()}").collect()
    assert [r["customer_id"] for r in got] == [customer] and got[0]["orders"] == (own["customer_id"] == customer).sum()
    status = own["status"].dropna().mode()[0]
    assert answer(spark, f"count of orders status:{status}").first()["orders"] == (own["status"].str.strip().str.lower() == status.strip().lower()).sum()
    assert answer(spark, "count of orders above 200").first()["orders"] == (own["cents"] > 20000).sum()
    product = corpus.lines(spark, SF).where("product_id is not null").first()["product_id"]
    got = answer(spark, f"revenue product_id={product}").collect()
    assert got and {r["product_id"] for r in got} == {product}


def test_pages(spark):
    every = [tuple(r) for r in answer(spark, "How many interactions did each customer have?").orderBy("customer_id").collect()]
    page = [tuple(r) for r in answer(spark, "How many interactions did each customer have? page 2").collect()]
    assert page == sorted(every)[20:40]
    assert answer(spark, "How many interactions did each customer have? Show 3 results").count() == 3


def test_what_cannot_be_obeyed_is_said(spark):
    for q in ("List every field named 'product_id' on 2024-03-18", "how many interactions next page", "hello there"):
        assert answer(spark, q).first()["status"] == "unsupported"


def test_numbers_of_documents(spark):
    low, high = (answer(spark, f"every numerical value above {n}").count() for n in (50, 500))
    assert low > answer(spark, "every numerical value").count() > high


def test_without_between_and_by(spark, own):
    status = own["status"].dropna().mode()[0]
    rest = own[own["status"].str.strip().str.lower() != status.strip().lower()]
    assert answer(spark, f"count of orders status!={status}").first()["orders"] == len(rest)
    assert answer(spark, "count of orders between 100 and 200").first()["orders"] == ((own["cents"] >= 10000) & (own["cents"] <= 20000)).sum()
    got = {r["month"]: r["orders"] for r in answer(spark, "total value of orders per month").collect()}
    assert got == own["day"].str[:7].value_counts().to_dict()
    got = {r["status"]: r["value"] for r in answer(spark, "maximum amount of orders by status").collect()}
    want = own.groupby("status", dropna=False)["cents"].max()
    assert got[status] == pytest.approx(want[status] / 100)

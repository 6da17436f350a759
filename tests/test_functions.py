from pyspark.sql import functions as F

from jsonloom.functions import scalars as S
from jsonloom.functions.embedding import embed, hash_vectors
from jsonloom.functions.keys import iso_micros, latest, norm_key


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_keys(spark):
    assert column(spark, norm_key, [" a1 ", "\tB ", "", "  ", None]) == ["A1", "B", None, None, None]


def test_iso_micros(spark):
    h = 3_600_000_000
    base = 20089 * 24 * h
    got = column(spark, iso_micros, ["2025-01-01T02:00:00Z", "2025-01-01T02:00:00+02:00", "2025-01-01T02:00:00-0130", "2025-01-01 02:00:00.5", "2025-01-01", " 2025-01-01T02:00:00+02 ", "x", "", None])
    assert got == [base + 2 * h, base, base + 3 * h + h // 2, base + 2 * h + 500_000, base, base, None, None, None]


def test_latest_breaks_ties(spark, rows):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, "z"), ("b", None, 1, "n"), ("b", None, 2, "m")], "k string, at int, id int, v string")
    assert rows(latest(df, ["k"], "at", "id").select("k", "v")) == [("a", "z"), ("b", "m")]


def test_paths(spark):
    assert column(spark, S.normalize_path, [" a[0] . b..c.", "[1][2].x", ""]) == ["a.0.b.c", "1.2.x", ""]
    assert column(spark, S.path_kind, ["paid", "order_date", "full name", "total", "x"]) == ["identifier", "temporal", "descriptor", "metric", "unknown"]
    assert column(spark, S.path_category, ["candidate", "user.email", "price[0]", "discount", "a.stock.status", "b"]) == ["temporal", "contact", "general", "financial", "quantity", "general"]


def test_timestamps(spark):
    found = [str(x) if x else None for x in column(spark, S.find_timestamp, ["on 2024/03/18 10:00:00", "2024-03-18T09:15:30Z x", "2024-13-01", "", None, "d 2024-02-29"])]
    assert found == ["2024-03-18 10:00:00", "2024-03-18 09:15:30", None, None, None, "2024-02-29 00:00:00"]
    parsed = [str(x) if x else None for x in column(spark, S.parse_timestamp, ["01/02/2024 00:00:00", "01/22/2024 00:00:00", "2024-01-01", "2024-01-01 x"])]
    assert parsed == ["2024-02-01 00:00:00", "2024-01-22 00:00:00", "2024-01-01 00:00:00", None]


def test_meta(spark):
    assert [m["magnitude"] for m in column(spark, S.numeric_meta, [0.0, 100.0, -0.05, None], "double")] == [0, 2, -2, None]
    assert column(spark, S.timestamp_format, ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+01:00", "1700000000", "2024-01-01 00:00:00", "2024-01-01", "x"]) == ["ISO8601_UTC", "ISO8601_OFFSET", "UNIX_TIMESTAMP", "DATETIME", "DATE", None]


def test_groups(spark):
    fields = ['{"timestamp":"2024-01-01T10:00:00Z","type":"a"}', '{"type":"a"}', '{"category":null}', "{}"]
    assert column(spark, S.group_type, fields) == ["date", "type", "category", "default"]
    assert column(spark, S.group_key, fields) == ["2024-01-01", "a", "unknown", "unknown"]


def test_embedding(spark):
    got = column(spark, embed, ["two words", "", None, "words two"])
    assert got[1] is None and got[2] is None and got[0] == got[3] and abs(sum(x * x for x in got[0]) - 1) < 1e-5
    assert not hash_vectors(["!?"]).any()


def test_functions_in_sql(spark):
    from jsonloom.functions import sql

    sql.register(spark)
    rows = spark.sql("""select k, n.* from values (1, '{"a": [1, {"b": null}]}'), (2, 'no'), (3, null) as d(k, t), lateral json_nodes(d.t) n""").collect()
    assert [(r["k"], r["path"], r["kind"], r["value"], r["depth"]) for r in rows] == [(1, "a", "array", None, 1), (1, "a[0]", "int", "1", 2), (1, "a[1]", "object", None, 2), (1, "a[1].b", "null", None, 3)]
    r = spark.sql("select normalize_json_path('.a [0]..b.') as p, hash_embedding('x y') as v, hash_embedding('') as e").first()
    assert r["p"] == "a.0.b" and len(r["v"]) == 384 and r["e"] is None

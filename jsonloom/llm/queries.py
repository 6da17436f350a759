"""The queries pN_ of the problems tagged llm and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm import bpe, leaks, neighbours, pii, spans, together
from jsonloom.session import table

DIM = 384


TEXTS = ["review_text", "description"]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer_interactions")
    return pii.find_pii(rows, "record_id", TEXTS, pii.fit_model(rows, "record_id", TEXTS))


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer_interactions")
    return pii.redact_pii(rows, "record_id", TEXTS, pii.fit_model(rows, "record_id", TEXTS))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    got = neighbours.similar_rows(table(spark, sf, "json_chunks"), "chunk_no", "embedding", DIM, k=10, recall=0.995, least=0.9)
    return got.select(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b")).distinct()


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 most similar rows of each row whose id is divisible by 20, against all rows."""
    got = neighbours.similar_rows(table(spark, sf, "json_chunks"), "chunk_no", "embedding", DIM, k=10, ask=F.col("id") % 20 == 0)
    return got.select(F.col("a").alias("chunk_no"), F.col("b").alias("neighbour"), F.round("sim", 9).alias("similarity"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    got = together.pairs_together(together.order_baskets(table(spark, sf, "order_transactions")), "products", support=12, lift=6.0)
    return got.select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"))


def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    got = together.pairs_together(together.order_baskets(table(spark, sf, "order_transactions")), "products", support=5)
    return got.select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), "n_ab", "n_a", "n_b", "n_all", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p5_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair that occurs together, however seldom."""
    got = together.pairs_together(together.order_baskets(table(spark, sf, "order_transactions")), "products")
    return got.select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), "n_ab", "n_a", "n_b", "n_all", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf, "documents"), "doc_id", "text")


def p8_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens per source."""
    docs = table(spark, sf, "documents")
    n = bpe.encode_texts(docs, "doc_id", "text").select("doc_id", F.size("ids").alias("n"))
    return docs.select("doc_id", "source").join(n, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))


def _leak_index(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.build_index(table(spark, sf, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_passages(_leak_index(spark, sf), table(spark, sf, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked: documents, and how much of the item at most."""
    got = leaks.find_passages(_leak_index(spark, sf), table(spark, sf, "eval_items"), "item_id", "text")
    return got.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("matched_words").alias("most_words"), F.max("item_words").alias("item_words"), F.max("longest_run").alias("longest_run"))


def p9_near(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_near(_leak_index(spark, sf), table(spark, sf, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf, "documents"), "doc_id", "text")


def p10_share(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_amount(table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p3_found, p3_redacted, p4_found, p4_neighbours, p5_found, p5_pairs, p5_all, p8_ids, p8_tokens, p9_found, p9_report, p9_near, p10_found, p10_share)}

_PAIRS = """
with o as (select *, row_number() over (partition by order_id order by ingested_at desc, record_id desc) rn from order_transactions where order_id is not null),
total as (select count(*) n_all from o where rn = 1),
x as (select distinct order_id, nullif(upper(trim(u.product_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '') p from (select order_id, unnest(items) u from o where rn = 1)),
single as (select p, count(*) n from x where p is not null group by 1),
pair as (select a.p a, b.p b, count(*) n_ab from x a join x b on a.order_id = b.order_id and a.p < b.p group by 1, 2),
full_pair as (select a, b, n_ab, sa.n n_a, sb.n n_b, n_all, n_ab::double * n_all / (sa.n * sb.n) lift from pair join single sa on a = sa.p join single sb on b = sb.p, total)
"""
_X = "case when {0} > 0 then ({0}) * ln({0}) else 0 end"
_G2 = " + ".join(_X.format(k) for k in ("n_ab", "(n_a - n_ab)::double", "(n_b - n_ab)::double", "(n_all - n_a - n_b + n_ab)::double", "n_all::double")) + "".join(" - (" + _X.format(k) + ")" for k in ("n_a::double", "(n_all - n_a)::double", "n_b::double", "(n_all - n_b)::double"))

ORACLE = {
    "p5_found": _PAIRS + "select a as product_a, b as product_b from full_pair where n_ab >= 12 and n_ab::double * n_all >= 6.0 * n_a * n_b",
    "p5_pairs": _PAIRS + f"select a as product_a, b as product_b, n_ab, n_a, n_b, n_all, round(lift, 6) as lift, round(greatest(0.0, 2 * ({_G2})), 4) as llr from full_pair where n_ab >= 5",
    "p5_all": _PAIRS + f"select a as product_a, b as product_b, n_ab, n_a, n_b, n_all, round(lift, 6) as lift, round(greatest(0.0, 2 * ({_G2})), 4) as llr from full_pair",
    "p9_found": """
with w as (select doc_id id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') ws from documents where text is not null),
v as (select item_id id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') ws from eval_items where text is not null),
dg as (select id, unnest([array_to_string(ws[i:i + 9], ' ') for i in range(1, len(ws) - 8)]) g from w where len(ws) >= 10),
ig as (select id, unnest([array_to_string(ws[i:i + 9], ' ') for i in range(1, len(ws) - 8)]) g from v where len(ws) >= 10)
select distinct dg.id as doc_id, ig.id as item_id from dg join ig using (g)""",
    "p9_report": """
with w as (select doc_id id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') ws from documents where text is not null),
v as (select item_id id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') ws from eval_items where text is not null),
dg as (select id, unnest([{'p': i, 'g': array_to_string(ws[i:i + 9], ' ')} for i in range(1, len(ws) - 8)], recursive := true) from w where len(ws) >= 10),
ig as (select id, unnest([{'p': i, 'g': array_to_string(ws[i:i + 9], ' ')} for i in range(1, len(ws) - 8)], recursive := true) from v where len(ws) >= 10),
m as (select dg.id d, ig.id it, dg.p dp, ig.p ip from dg join ig using (g)),
covered as (select d, it, count(distinct ip + k) c from m, (select unnest(range(10)) k) group by 1, 2),
islands as (select d, it, dp - ip shift, ip - row_number() over (partition by d, it, dp - ip order by ip) island from m),
runs as (select d, it, max(n) + 9 run from (select d, it, shift, island, count(*) n from islands group by 1, 2, 3, 4) group by 1, 2)
select it as item_id, count(*) as documents, max(c)::bigint as most_words, max(len(v.ws))::bigint as item_words, max(run)::bigint as longest_run
from covered join runs using (d, it) join v on v.id = it group by 1""",
}

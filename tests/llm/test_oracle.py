import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from jsonloom.llm import registry
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(oracle.DATA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    oracle.compare(spark, con, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_and_values(spark, name):
    got = registry.queries()[name](spark, oracle.DATA)
    oracle.filled(got.withColumn("ids", F.col("ids").cast("string")) if "ids" in got.columns else got)


def read(name, *cols):
    return pq.read_table(f"{oracle.DATA}/{name}.parquet", columns=list(cols)).to_pylist()


def test_neighbours_against_brute_force(spark):
    rows = [(r["chunk_no"], np.array(r["embedding"], float)) for r in read("json_chunks", "chunk_no", "embedding") if r["embedding"] and len(r["embedding"]) == 384 and any(r["embedding"])]
    ids = np.array([i for i, _ in rows])
    x = np.stack([v / np.linalg.norm(v) for _, v in rows])
    got = {}
    for r in registry.queries()["p4_neighbours"](spark, oracle.DATA).collect():
        got.setdefault(r["chunk_no"], []).append(r["similarity"])
    assert set(got) == {i for i in ids if i % 20 == 0}
    for i, s in zip(ids, x @ x.T):
        if i in got:
            best = np.sort(s[ids != i])[::-1][:10]
            assert np.allclose(sorted(got[i], reverse=True), best, atol=1e-8)


def test_leak_report_against_brute_force(spark):
    words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    docs = {r["doc_id"]: words(r["text"]) for r in read("documents", "doc_id", "text")}
    grams = {}
    for d, ws in docs.items():
        for i in range(len(ws) - 9):
            grams.setdefault(tuple(ws[i : i + 10]), set()).add(d)
    want = {}
    for r in read("eval_items", "item_id", "text"):
        ws, covered = words(r["text"]), {}
        for i in range(len(ws) - 9):
            for d in grams.get(tuple(ws[i : i + 10]), ()):
                covered.setdefault(d, set()).update(range(i, i + 10))
        if covered:
            want[r["item_id"]] = (len(covered), max(map(len, covered.values())), len(ws))
    got = {r["item_id"]: (r["documents"], r["most_words"], r["item_words"]) for r in registry.queries()["p9_report"](spark, oracle.DATA).collect()}
    assert got == want and want


def test_redacted_texts_hold_what_was_not_found(spark):
    spans = {}
    for r in registry.queries()["p3_found"](spark, oracle.DATA).collect():
        spans.setdefault((r["record_id"], r["field_name"]), []).append((r["start_pos"], r["end_pos"], r["pii_type"]))
    redacted = {r["record_id"]: r for r in registry.queries()["p3_redacted"](spark, oracle.DATA).collect()}
    for r in read("customer_interactions", "record_id", "review_text", "description"):
        for f in ("review_text", "description"):
            text = r[f]
            for a, b, k in sorted(spans.get((r["record_id"], f), []), reverse=True):
                text = f"{text[:a]}[{k.upper()}]{text[b:]}"
            assert redacted[r["record_id"]][f] == text

import os
import random

import pytest

from jsonloom.llm import bpe as B

pytestmark = pytest.mark.skipif(not os.path.isdir(B.TOKENIZERS), reason="no vocabularies")


@pytest.fixture(scope="module")
def encoder():
    with open(f"{B.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return B.Encoder(B.read_ranks(f.read()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{B.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


TEXTS = ["Hello world", " I'll've don't", "<|endoftext|> as text", "\n\n  \t x y z  ", "漢字かな混じり 😀👍🏽", "1234567 3.14 --- ===", "a" * 5000, "​\x1c\x00é́", "Straße l'été ¿qué? O'Brack", "{\"a\": [1, null]}", "ÀÉ" * 700]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(text, encoder, library):
    assert encoder.encode(text) == library(text)
    assert encoder.decode(encoder.encode(text)) == text


def test_random(encoder, library):
    rnd = random.Random(8)
    for _ in range(300):
        t = "".join(rnd.choice("abcdeXYZ  '\n.,0159éß漢😀_-") for _ in range(rnd.randint(1, 60)))
        assert encoder.encode(t) == library(t)


def test_heap_skips_stale_entries(encoder, library):
    word = "internationalization" * 50
    assert encoder.piece(word.encode()) == library(word)


def test_spark(spark):
    df = spark.createDataFrame([(1, "Hello"), (2, ""), (3, None), (4, " world"), (4, " world")], "doc_id bigint, text string").withColumn("ids", df_lit())
    got = sorted((r["doc_id"], list(r["ids"])) for r in B.encode_texts(df, "doc_id", "text").collect())
    assert got == [(1, [15496]), (2, []), (3, []), (4, [995]), (4, [995])]
    back = B.decode_texts(B.encode_texts(df, "doc_id", "text"), "doc_id", "ids")
    assert sorted((r[0], r[1]) for r in back.collect()) == [(1, "Hello"), (2, ""), (3, ""), (4, " world"), (4, " world")]
    assert B.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("a column named like the result")

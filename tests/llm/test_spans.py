import random

import numpy as np
import pytest

from jsonloom.llm import spans as S


def brute(docs, least):
    seen = {}
    for d, t in docs:
        for p in range(len(t or "") - least + 1):
            seen.setdefault(t[p : p + least], set()).add(d)
    out = set()
    for d, t in docs:
        cover = [False] * len(t or "")
        for p in range(len(t or "") - least + 1):
            if len(seen[t[p : p + least]]) > 1:
                cover[p : p + least] = [True] * least
        a = None
        for i, c in enumerate([*cover, False]):
            if c and a is None:
                a = i
            elif not c and a is not None:
                out.add((d, a, i))
                a = None
    return out


def spans(spark, docs, least=200):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id bigint, text string, doc string, at int")
    return [tuple(r) for r in S.shared_spans(df, "doc_id", "text", least).collect()]


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("abcde é漢😀\n") for _ in range(n))
    source = text(3000)
    docs = [(0, source), (1, None), (2, ""), (3, "short"), (4, source[100:900]), (5, source[100:900])]
    for d in range(6, 60):
        a, n = rnd.randint(0, 2500), rnd.choice([150, 199, 200, 201, 230, 400])
        docs.append((d, text(rnd.randint(0, 90)) + source[a : a + n] + text(rnd.randint(0, 90)) + (source[:210] if d % 7 == 0 else "")))
    docs += [(70, "=" * 500), (71, "x" + "=" * 260 + "y"), (72, "ab" * 300), (73, "q" + "ab" * 150), (74, text(50) + " " * 230 + source[500:730])]
    want = brute(docs, 200)
    for piece in (10**6, 1500):
        monkeypatch.setattr(S, "PIECE", piece)
        got = spans(spark, docs)
        assert len(got) == len(set(got)) and set(got) == want


def test_names_tell_substrings_apart():
    rng = np.random.default_rng(3)
    codes = np.concatenate([rng.integers(97, 99, 1500), np.full(300, 97), np.tile([97, 98], 150), np.tile([97, 97, 98], 100), rng.integers(97, 99, 1500), np.full(200, 97)]).astype(np.uint32)
    text_of = np.repeat([0, 1], [1800, len(codes) - 1800])  # a run ends at the border of two texts
    symbols = S.Symbols(codes, text_of)
    assert len(symbols.name) < len(codes) / 4
    for size in (1, 2, 3, 7, 20, 60):
        a = np.concatenate([np.arange(1800 - size + 1), np.arange(1800, len(codes) - size + 1)])
        names = symbols.names(a, a + size)
        by_text, by_name = {}, {}
        for i, n in zip(a, names):
            t = codes[i : i + size].tobytes()
            assert by_text.setdefault(t, n) == n and by_name.setdefault(n, t) == t


def test_rounds_name_runs_and_pairs():
    codes = np.frombuffer("xyaaaaxyaaaaq".encode("utf-32-le"), np.uint32)
    base, start, stop, *_ = S.Symbols(codes, np.zeros(len(codes), np.int8), 1).rounds[0]
    assert list(stop - start) == [1, 1, 4, 1, 1, 4, 1] and base[2] == base[5]


def test_kept_names_reveal_every_shared_span():
    rng = np.random.default_rng(4)
    for n in range(60):
        core = rng.integers(97, 100, 100) if n % 3 else np.tile(rng.integers(97, 100, 1 + n % 5), 100)[:100]
        kept = []
        for _ in range(2):
            codes = np.concatenate([rng.integers(97, 100, rng.integers(0, 40)), core, rng.integers(97, 100, rng.integers(0, 40))]).astype(np.uint32)
            sizes = np.array([len(codes)])
            kept.append(set(S.kept(S.Symbols(codes, np.zeros(len(codes), np.int8)), sizes, 100, 70)[0].tolist()))
        assert kept[0] & kept[1]


def test_repeats_within_one_text_do_not_count(spark):
    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    assert spans(spark, [(1, t + "--" + t)]) == [] and spans(spark, []) == []


def test_amount(spark):
    t = "".join(random.Random(2).choice("abcdefgh") for _ in range(300))
    df = spark.createDataFrame([(1, t), (2, t), (3, t[:250] + "zz" * 125), (4, None)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in S.shared_amount(df, "doc_id", "text").collect()) == [(1, 300, 300, 1.0), (2, 300, 300, 1.0), (3, 500, 250, 0.5), (4, 0, 0, 0.0)]


def test_shorter_spans(spark):
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    docs = [(d, text(300)) for d in range(12)] + [(20, "a" * 40), (21, "b" + "a" * 30)]
    for least in (12, 30):
        assert set(spans(spark, docs, least)) == brute(docs, least)
    with pytest.raises(ValueError):
        S.shared_spans(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", 0)

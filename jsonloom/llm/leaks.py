"""Evaluation texts inside training texts (problem 9), by a positional inverted index.

The index is partitioned by document: each segment is one row with the terms of some documents and,
per term, a sorted list of (document, position). It is written once to the shared folder and serves
any number of query sets. A query set (counted; taken in blocks of `BLOCK_WORDS` words) is
broadcast to the segments, so building and probing need no shuffle and no term's list has to fit
into one task. A phrase is found by intersecting the offset-adjusted lists of its terms, from the
rarest (by document frequency in the whole corpus) on.

Defined cases: words are maximal runs of Unicode letters and digits in lower case; null, empty and
wordless texts match nothing; items of fewer than n words match nothing; repeated documents and
items each count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.session import spread, written

WORD = re.compile(r"[^\W_]+")
SEGMENT_WORDS = 400_000
#: Words of query texts that are broadcast at once.
BLOCK_WORDS = 1_000_000
#: Words of a stretch of an item, at least, that is looked for by proximity.
NEAR_WORDS = 8
SHIFT = 32
INDEX = "terms array<string>, starts array<int>, df array<int>, posting array<bigint>, docs array<bigint>"


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text)] if text else []


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    docs: list[int] = []
    tokens: list[str] = []
    where: list[np.ndarray] = []

    def segment() -> pd.DataFrame:
        at = np.concatenate(where)
        code, terms = pd.factorize(np.array(tokens, object), sort=True)
        order = np.lexsort((at, code))
        code, at = code[order], at[order]
        starts = np.searchsorted(code, np.arange(len(terms) + 1))
        doc = at >> SHIFT
        fresh = np.ones(len(at), np.int64)
        fresh[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
        df = np.add.reduceat(fresh, starts[:-1])
        return pd.DataFrame({"terms": [list(terms)], "starts": [starts.astype(np.int32)], "df": [df.astype(np.int32)], "posting": [at], "docs": [np.array(docs, np.int64)]})

    for pdf in batches:
        for doc, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
            ws = words(text)
            if not ws:
                continue
            where.append((np.int64(len(docs)) << SHIFT) + np.arange(len(ws), dtype=np.int64))
            docs.append(doc)
            tokens += ws
            if len(tokens) >= SEGMENT_WORDS:
                yield segment()
                docs, tokens, where = [], [], []
    if tokens:
        yield segment()


def build_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """The index of df's texts, written to the shared folder; each segment is one row."""
    segs = spread(df.select(F.col(key).cast("bigint"), F.col(text)).where(F.col(key).isNotNull())).mapInPandas(_segments, INDEX)
    return written(segs, "postings")


class Segment:
    def __init__(self, row):
        self.at = {t: i for i, t in enumerate(row.terms)}
        self.starts, self.posting, self.docs = np.asarray(row.starts), np.asarray(row.posting), np.asarray(row.docs)

    def positions(self, term: str) -> np.ndarray | None:
        i = self.at.get(term)
        return None if i is None else self.posting[self.starts[i] : self.starts[i + 1]]

    def phrase(self, terms: list[str], rank: dict[str, int]) -> np.ndarray:
        """The places (document << SHIFT | position) where terms stand one after the other."""
        lists = {}
        for t in terms:
            if t not in lists:
                p = self.positions(t)
                if p is None:
                    return np.zeros(0, np.int64)
                lists[t] = p
        order = sorted(range(len(terms)), key=lambda o: (rank.get(terms[o], 0), len(lists[terms[o]])))
        found = lists[terms[order[0]]] - order[0]
        found = found[(found & ((1 << SHIFT) - 1)) + order[0] < (1 << SHIFT)]  # not before the document's start
        for o in order[1:]:
            if not len(found):
                break
            p = lists[terms[o]]
            i = np.searchsorted(p, found + o)
            i[i == len(p)] = 0
            found = found[p[i] == found + o]
        return found

    def near(self, terms: list[str], span: int) -> np.ndarray:
        """Documents where all terms stand within `span` words around one place of the first."""
        lists = [self.positions(t) for t in terms]
        if any(p is None for p in lists):
            return np.zeros(0, np.int64)
        at = lists[0]
        for p in lists[1:]:
            low = np.searchsorted(p, np.maximum(at - span, (at >> SHIFT) << SHIFT))
            ok = low < len(p)
            ok[ok] = p[low[ok]] <= np.minimum(at[ok] + span, ((at[ok] >> SHIFT) << SHIFT) + (1 << SHIFT) - 1)
            at = at[ok]
        return np.unique(at >> SHIFT)


class Windows:
    """All runs of n words of some texts, and which of them a segment can hold at all."""

    def __init__(self, texts: list[list[str]], n: int):
        flat = [w for ws in texts for w in ws]
        code, self.terms = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), np.zeros(0, object))
        self.code, self.n = code, n
        sizes = np.array([len(ws) for ws in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.text = np.repeat(np.arange(len(texts)), np.maximum(sizes - n + 1, 0))
        self.offset = np.arange(len(self.text)) - np.repeat(np.cumsum(np.maximum(sizes - n + 1, 0)) - np.maximum(sizes - n + 1, 0), np.maximum(sizes - n + 1, 0))
        self.at = starts[self.text] + self.offset if len(texts) else np.zeros(0, np.int64)

    def possible(self, seg: Segment) -> Iterator[tuple[int, list[int]]]:
        """(text, offsets) of the runs of which the segment has every word."""
        if not len(self.at):
            return
        lacks = np.fromiter((t not in seg.at for t in self.terms), bool, len(self.terms))
        missing = np.concatenate([[0], np.cumsum(lacks[self.code])])
        ok = np.flatnonzero(missing[self.at + self.n] == missing[self.at])
        cuts = np.flatnonzero(np.diff(self.text[ok])) + 1
        for part in np.split(ok, cuts):
            if len(part):
                yield int(self.text[part[0]]), self.offset[part].tolist()


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The query set in blocks of at most BLOCK_WORDS words (or one text), streamed to the driver."""
    block, n = [], 0
    for r in items.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        ws = words(r[1])
        if n and n + len(ws) > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((r[0], ws))
        n += len(ws)
    yield block


def _ranks(index: DataFrame, block: list[tuple[int, list[str]]]) -> dict[str, int]:
    """Document frequencies, in the whole corpus, of the block's terms."""
    spark = index.sparkSession
    vocabulary = sorted({w for _, ws in block for w in ws})
    if not vocabulary:
        return {}
    q = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "term string"))
    counts = index.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), "df")).alias("x")).select("x.term", "x.df").join(q, "term").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counts.collect()}  # at most BLOCK_WORDS rows


def find_passages(index: DataFrame, items: DataFrame, item_key: str, item_text: str, n: int = 10) -> DataFrame:
    """(doc_id, item_id, matched_words, item_words, longest_run): each document and item with n consecutive words in common."""
    out = None
    for block in _blocks(items, item_key, item_text):
        rank = _ranks(index, block)
        asked = [(i, ws) for i, ws in block if len(ws) >= n]
        shared = index.sparkSession.sparkContext.broadcast((asked, rank, Windows([ws for _, ws in asked], n)))

        def probe(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            asked, rank, windows = shared.value
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    seg, rows = Segment(row), []
                    for k, offsets in windows.possible(seg):
                        item, ws = asked[k]
                        hits: dict[int, list[tuple[int, int]]] = {}
                        for o in offsets:
                            for place in seg.phrase(ws[o : o + n], rank).tolist():
                                hits.setdefault(place >> SHIFT, []).append(((place & ((1 << SHIFT) - 1)) - o, o))
                        for doc, found in hits.items():
                            covered = {w for _, o in found for w in range(o, o + n)}
                            best = run = 0
                            last = None
                            for shift, o in sorted(found):
                                run = run + 1 if last == (shift, o - 1) else n
                                best, last = max(best, run), (shift, o)
                            rows.append((int(seg.docs[doc]), item, len(covered), len(ws), best))
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "matched_words", "item_words", "longest_run"]).astype("int64")

        got = index.mapInPandas(probe, "doc_id bigint, item_id bigint, matched_words bigint, item_words bigint, longest_run bigint")
        out = got if out is None else out.unionByName(got)
    return out


def _near_terms(ws: list[str], rank: dict[str, int], terms: int, stretch: float) -> set[tuple[tuple[str, ...], int]]:
    """(words, span) to look for: the rarest known words of the item and of each of its stretches of at least NEAR_WORDS words."""
    rarest = lambda known: tuple(sorted(known, key=lambda w: (rank[w], w))[:terms])
    known = {w for w in ws if w in rank}  # words the corpus lacks cannot stand there
    got = {(rarest(known), int(len(ws) * stretch))} if known else set()
    for o in range(len(ws)):
        part: set[str] = set()
        for e in range(o, len(ws)):
            if ws[e] in rank:
                part.add(ws[e])
            if e + 1 - o >= NEAR_WORDS and len(part) >= terms:
                got.add((rarest(part), int((e + 1 - o) * stretch)))
                break
    return got


def find_near(index: DataFrame, items: DataFrame, item_key: str, item_text: str, terms: int = 6, stretch: float = 2.0) -> DataFrame:
    """(doc_id, item_id) where the `terms` rarest words of the item, or of a stretch of it, stand close together, in any order.

    Close is within `stretch` times the length of the item or stretch in words around a place of the
    rarest one. Of items with fewer known words all of them are looked for.
    """
    out = None
    for block in _blocks(items, item_key, item_text):
        rank = _ranks(index, block)
        asked = [(i, sorted(_near_terms(ws, rank, terms, stretch))) for i, ws in block]
        shared = index.sparkSession.sparkContext.broadcast(asked)

        def probe(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    seg = Segment(row)
                    rows = [(int(seg.docs[d]), item) for item, looks in shared.value for d in sorted({d for ts, span in looks for d in seg.near(ts, span).tolist()})]
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id"]).astype("int64")

        got = index.mapInPandas(probe, "doc_id bigint, item_id bigint")
        out = got if out is None else out.unionByName(got)
    return out

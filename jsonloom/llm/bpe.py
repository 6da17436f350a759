"""Encoding of texts with a public byte-level BPE vocabulary (problem 8).

The text is split by the vocabulary's pattern; each piece is a doubly linked list of byte symbols.
A priority queue holds the merge rank and place of each adjacent pair; the lowest rank is merged,
entries whose symbols have changed since are stale and skipped. Cost n log n per piece, also for a
piece of a megabyte. Decoding concatenates the vocabulary's byte strings.

Pieces repeat, so each worker keeps a bounded memo of them. The vocabulary (one file of fixed size)
goes to the executors as a broadcast.

Defined cases: empty and null texts give an empty list; strings that look like special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.session import spread

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text for these vocabularies, with \s as Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MEMO = 200_000
MEMO_PIECE = 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.memo = ranks, {}
        self.split = regex.compile(PATTERN).findall
        self.words: list[bytes] | None = None

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        ranks, n = self.ranks, len(data)
        whole = [data[i : i + 1] for i in range(n)]
        if n == 1:
            return [ranks[data]]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            if r is not None:
                queue.append((r, i, 1, 1))
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if whole[i] is None or len(whole[i]) != a or j >= n or len(whole[j]) != b:
                continue  # stale
            whole[i] += whole[j]
            whole[j] = None
            k = right[i] = right[j]
            size = a + b
            if k < n:
                left[k] = i
                r = ranks.get(whole[i] + whole[k])
                if r is not None:
                    heapq.heappush(queue, (r, i, size, len(whole[k])))
            h = left[i]
            if h >= 0:
                r = ranks.get(whole[h] + whole[i])
                if r is not None:
                    heapq.heappush(queue, (r, h, len(whole[h]), size))
        return [ranks[w] for w in whole if w is not None]

    def _new(self, piece: str) -> list[int]:
        ids = self.piece(piece.encode())
        if len(piece) <= MEMO_PIECE:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, new = self.memo.get, self._new
        return list(chain.from_iterable([memo(p) or new(p) for p in self.split(text)]))

    def decode(self, ids: list[int]) -> str:
        if self.words is None:
            self.words = [b""] * (max(self.ranks.values()) + 1)
            for w, i in self.ranks.items():
                self.words[i] = w
        return b"".join([self.words[i] for i in ids]).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    key = hash(shared.value)
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(shared.value))
    return _encoders[key]


def encode_texts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of each row, ids being those of the vocabulary `name`.tiktoken in `folder`."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return spread(df.select(F.col(key).cast("bigint"), F.col(text))).mapInArrow(run, f"{key} bigint, ids array<int>")


def decode_texts(df: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) of each row of ids."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([enc.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    return df.select(F.col(key).cast("bigint"), F.col(ids)).mapInArrow(run, f"{key} bigint, text string")

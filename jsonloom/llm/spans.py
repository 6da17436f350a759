"""Long exact spans shared between texts (problem 10), by recompression.

Naming. A text is a row of symbols, at first its code points. A round names two things: each run of
one symbol (the symbol and how often it stands there), and then each adjacent pair of a left and a
right symbol, sides being a bit of the name. Names are 64-bit hashes of what they stand for, so every
task gives equal runs and pairs the same name without a dictionary that would have to be shuffled,
and one pass over a text makes all its rounds. What is named depends on nothing outside it but for
the ends: a run may go on and a symbol may pair beyond the end of a substring.

Names of substrings. So a substring is named by the symbols that every place of it has: in each
round the run at either end is taken off as (symbol, how often inside), then a right symbol at the
left end and a left symbol at the right end; what stays is a row of whole symbols of the next round.
The name is the hash of what was taken off and of the row left after ROUNDS rounds. Substrings of
the same characters have the same name wherever they stand, and it is read off the rows of symbols
without going through the characters.

Reveal. Of the names of the substrings of `REVEAL` characters at `least - REVEAL + 1` starts one
after the other the smallest is kept. Every shared span of `least` characters, wherever it stands,
contains all these substrings in both texts, so both keep the same one: symbols kept by two texts
reveal all shared spans.

Verification. A kept substring that two texts share lies in at most `least - REVEAL + 1` spans of
`least` characters of a text; the names of these (with a checksum of the characters, 128 bits
together) are compared among all texts. Those that two texts have are shared, and touching ones are
united. Groups are only aggregated (least and largest text id), never collected and never paired.

Exact copies are one text: their whole text is shared, and one of them stands for all elsewhere.

Defined cases: null, empty and short texts share nothing; positions are code points; repeats within
one text do not count; long texts are worked through in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.session import broadcast_if_small, spread, written

ROUNDS = 4
REVEAL = 150
PIECE = 1 << 16
#: Names found in two texts that may be broadcast (16 bytes each) to find their places.
SENT = 1_000_000

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _run_name(name: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The name of so many of one symbol; a single one keeps its name."""
    return np.where(size > 1, _mix(name + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), name)


def _pair_name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * _ODD + (right ^ _U(0xA0761D6478BD642F)))


#: Weights of what a round takes off the ends: the run and the single symbol, at the left and at the right.
_WEIGHTS = _mix(np.arange(1, 4 * 16 + 1, dtype=np.uint64) * _ODD).reshape(16, 4) | _U(1)


class Symbols:
    """All rounds of some texts, set one behind the other and told apart by text_of.

    Per round: the symbols of the runs (base), where they begin and stop, the run of each position,
    the names of the runs, which of them are left, and the symbol of the next round each is in.
    """

    def __init__(self, codes: np.ndarray, text_of: np.ndarray, rounds: int = ROUNDS):
        name = _mix(codes.astype(np.uint64) + _ODD)
        border = np.ones(len(name), bool)  # the first symbol of a text
        np.not_equal(text_of[1:], text_of[:-1], out=border[1:])
        self.rounds = []
        for r in range(rounds):
            first = border.copy()
            first[1:] |= name[1:] != name[:-1]
            start = np.flatnonzero(first)
            run_of = np.cumsum(first, dtype=np.int32) - 1
            stop = np.append(start[1:], len(name))
            base = name[start]
            named, border = base.copy(), border[start]
            many = np.flatnonzero(stop - start > 1)
            named[many] = _run_name(base[many], (stop - start)[many])
            left = (named & _U(1 << (5 + r))) == 0  # names are hashes, so any bit tells two sides
            heads = np.flatnonzero(left[:-1] & ~left[1:] & ~border[1:])
            keep = np.ones(len(named), bool)
            keep[heads + 1] = False
            up = np.cumsum(keep, dtype=np.int32) - 1
            self.rounds.append((base, start, stop, run_of, named, left, up))
            name, border = named[keep], border[keep]
            name[up[heads]] = _pair_name(named[heads], named[heads + 1])
        power = np.cumprod(np.full(len(name) + 1, _U(0xD6E8FEB86659FD93)), dtype=np.uint64)
        self.back = np.cumprod(np.full(len(name) + 1, _U(pow(0xD6E8FEB86659FD93, -1, 2**64))), dtype=np.uint64)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(name * power[:-1], dtype=np.uint64)])
        self.name = name
        self._ends()

    def _ends(self) -> None:
        """For each position the hash of what a substring that begins (ends) there loses, and where its row left begins (ends).

        From the last round down, so that each round costs its own number of symbols. They hold for
        substrings long enough that the two ends do not meet. The hash is the sum of the names taken
        off, weighed by round and end.
        """
        n = len(self.name)
        lose_l, lose_r = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        from_l = np.arange(n + 1, dtype=np.int32)
        to_r, zero = from_l, np.zeros(1, np.uint64)
        for r in range(len(self.rounds) - 1, -1, -1):
            base, start, stop, run_of, named, left, up = self.rounds[r]
            m = len(named)
            # behind each run a right symbol is taken off too
            off = np.zeros(m, bool)
            off[:-1] = ~left[1:]
            extra = np.zeros(m, np.uint64)
            extra[:-1] = named[1:] * off[:-1]
            up_to = np.append(up, np.int32(len(lose_l) - 1))
            nxt = up_to[np.minimum(np.arange(1, m + 1, dtype=np.int32) + off, m)]
            g_l, c_l = extra * _WEIGHTS[r, 1] + lose_l[nxt], from_l[nxt]
            # before each run a left symbol
            off = np.zeros(m, bool)
            off[1:] = left[:-1]
            extra = np.zeros(m, np.uint64)
            extra[1:] = named[:-1] * off[1:]
            last = np.arange(m, dtype=np.int32) - off  # one past the last symbol that stays
            nxt = np.concatenate([np.zeros(1, np.int32), up + np.int32(1)])[last]
            g_r, c_r = extra * _WEIGHTS[r, 3] + lose_r[nxt], to_r[nxt]
            size = stop - start
            if (size > 1).any():
                own = base[run_of]
                rest, past = own, own.copy()  # runs cut by the beginning, by the end
                i = np.flatnonzero(size[run_of] > 1)
                x = run_of[i]
                past[i] = _run_name(base[x], i + 1 - start[x])
                rest[i] = _run_name(base[x], stop[x] - i)
                g_l, c_l, g_r, c_r = g_l[run_of], c_l[run_of], g_r[run_of], c_r[run_of]
            else:
                rest = past = base
            lose_l = np.concatenate([rest * _WEIGHTS[r, 0] + g_l, zero])
            lose_r = np.concatenate([zero, past * _WEIGHTS[r, 2] + g_r])
            from_l, to_r = np.append(c_l, np.int32(n)), np.concatenate([np.zeros(1, np.int32), c_r])
        self.lose_l, self.lose_r, self.from_l, self.to_r = lose_l, lose_r, from_l, to_r

    def names(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The names of the substrings [a, b), none of which leaves its text.

        Whether the ends meet (few do: in a long run, say) is told by the characters of the substring
        alone; these are named step by step.
        """
        i, j = self.from_l[a], self.to_r[b]
        core = (self.total[j] - self.total[i]) * self.back[i] + (j - i).astype(np.uint64)
        out = _mix(_mix(self.lose_l[a] * _ODD + core) + self.lose_r[b])
        meet = np.flatnonzero(i >= j)
        if len(meet):
            out[meet] = self._stepwise(a[meet], b[meet])
        return out

    def _stepwise(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hl, hr = np.full(len(a), _U(1)), np.full(len(a), _U(2))

        def take(h: np.ndarray, name: np.ndarray, mark: int, which: np.ndarray) -> np.ndarray:
            return np.where(which, _mix(h * _ODD + name + _U(mark)), h)

        for base, start, stop, run_of, named, left, up in self.rounds:
            some = a < b
            i, j = np.minimum(a, len(run_of) - 1), np.maximum(b - 1, 0)
            x, y = run_of[i], run_of[j]
            one = x == y
            # the run at the left end, as far as it lies inside, and the one at the right end
            size = np.minimum(stop[x], b) - a
            hl = take(hl, _run_name(base[x], np.maximum(size, 1)), 0x51, some)
            both = some & ~one
            size = b - np.maximum(start[y], a)
            hr = take(hr, _run_name(base[y], np.maximum(size, 1)), 0x52, both)
            a, b = np.where(some, x + 1, 0), np.where(some, y, 0)
            # a right symbol at the left end, a left symbol at the right end
            some = a < b
            i = np.minimum(a, len(named) - 1)
            off = some & ~left[i]
            hl = take(hl, named[i], 0x53, off)
            a = a + off
            some = a < b
            j = np.maximum(b - 1, 0)
            off = some & left[j]
            hr = take(hr, named[j], 0x54, off)
            b = b - off
            some = a < b
            i, j = np.minimum(a, len(up) - 1), np.maximum(b - 1, 0)
            a, b = np.where(some, up[i], 0), np.where(some, up[j] + 1, 0)
        core = (self.total[b] - self.total[a]) * self.back[a] + (b - a).astype(np.uint64)
        return _mix(_mix(hl * _ODD + core) + hr)


def _slide(h: np.ndarray, size: int, of) -> np.ndarray:
    """of(h[i:i + size]) for each i, `of` being np.minimum or np.maximum."""
    width = 1
    while 2 * width <= size:
        h, width = of(h[: len(h) - width], h[width:]), 2 * width
    n = len(h) - (size - width)
    return of(h[:n], h[size - width : size - width + n])


def kept(symbols: Symbols, sizes: np.ndarray, least: int, reveal: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, starts) of the kept substrings of texts of these sizes, set one behind the other."""
    ends = np.cumsum(sizes)
    reach = least - reveal + 1
    n = np.maximum(sizes - reveal + 1, 0)  # starts of each text
    first = np.repeat(ends - sizes, n)
    place = np.arange(n.sum())
    starts = first + place - np.repeat(np.cumsum(n) - n, n)
    if len(starts) < reach:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = symbols.names(starts, starts + reveal)
    full = starts[: len(starts) - reach + 1] == starts[reach - 1 :] - reach + 1  # ranges within one text
    low = np.where(full, _slide(h, reach, np.minimum), _U(0))
    # a name is the least of some range around it if the greatest of their least is itself
    pad = np.zeros(reach - 1, np.uint64)
    best = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), reach, np.maximum) == h)
    name, at = h[best], starts[best]
    # in a run many starts have one name: of those close together the first and the last stay
    link = (name[1:] == name[:-1]) & (at[1:] - at[:-1] < reach) & (at[1:] // reach == at[:-1] // reach)
    inner = np.zeros(len(name), bool)
    inner[1:-1] = link[1:] & link[:-1]
    return name[~inner], at[~inner]


def _pieces(docs: list[int], texts: list[str], least: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of about `piece` code points: (codes, sizes of the texts, doc ids, offset of each text in its doc less its place here).

    Pieces of a long text overlap so far that each span of `least` characters lies in one of them.
    """
    codes: list[np.ndarray] = []
    ids: list[int] = []
    offs: list[int] = []
    n = 0

    def batch():
        sizes = np.array([len(c) for c in codes])
        return np.concatenate(codes), sizes, np.array(ids), np.array(offs) - (np.cumsum(sizes) - sizes)

    for doc, text in zip(docs, texts):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for off in range(0, max(1, len(c) - least + 1), piece):
            part = c[off : off + piece + least]
            codes.append(part), ids.append(doc), offs.append(off)
            n += len(part)
            if n >= piece:
                yield batch()
                codes, ids, offs, n = [], [], [], 0
    if codes:
        yield batch()


def _kept_batches(least: int, reveal: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, sizes, ids, offs in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), least, piece):
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                name, at = kept(Symbols(codes, text_of), sizes, least, reveal)
                t = text_of[at]
                yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(ids[t], pa.int64()), pa.array(at + offs[t], pa.int64())], ["name", "doc", "at"])

    return run


def _checksums(codes: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    base = 0xC2B2AE3D27D4EB4F
    power = np.cumprod(np.full(len(codes), _U(base)), dtype=np.uint64)
    back = np.cumprod(np.full(len(codes), _U(pow(base, -1, 2**64))), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64) + _U(2)) * power, dtype=np.uint64)])
    return _mix((total[starts + least] - total[starts]) * back[starts])


def _span_batches(least: int, reveal: int, piece: int):
    """(h1, h2, doc, at): name and checksum of the spans around the shared substrings of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            places = dict(zip(docs, batch.column(2).to_pylist()))
            for codes, sizes, ids, offs in _pieces(docs, batch.column(1).to_pylist(), least, piece):
                ends = np.cumsum(sizes)
                low, high = [], []
                for doc, off, end, size in zip(ids.tolist(), offs.tolist(), ends.tolist(), sizes.tolist()):
                    z = np.array(places[doc], np.int64) - off  # places in the piece, of which some may lie outside
                    z = z[(z > end - size - reveal) & (z < end)]
                    low.append(np.clip(z + reveal - least, end - size, end - least + 1)), high.append(np.clip(z + 1, end - size, end - least + 1))
                mark = np.zeros(len(codes) + 1, np.int32)
                np.add.at(mark, np.concatenate(low), 1)
                np.add.at(mark, np.concatenate(high), -1)
                at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                at = at[at - (ends - sizes)[text_of[at]] < piece]  # later ones are the next piece's
                if not len(at):
                    continue
                h1, h2 = Symbols(codes, text_of).names(at, at + least), _checksums(codes, at, least)
                t = text_of[at]
                yield pa.record_batch([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[t], pa.int64()), pa.array(at + offs[t], pa.int64())], ["h1", "h2", "doc", "at"])

    return run


def _in_two(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows of df whose `by` stands in two or more docs."""
    two = df.groupBy(*by).agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).where("_a <> _b").select(*by)
    return df.join(broadcast_if_small(written(two, "in-two"), SENT), by, "left_semi")


def shared_spans(df: DataFrame, key: str, text: str, least: int = 200, reveal: int | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos): maximal runs of characters that lie in spans of `least` or more that another text has too.

    reveal: characters of the substrings by which spans are first found (REVEAL, or three quarters of a smaller `least`).
    """
    reveal = min(REVEAL, least * 3 // 4) if reveal is None else reveal
    if not 1 <= reveal <= least:
        raise ValueError("reveal must be between 1 and least")
    docs = spread(df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))).withColumn("n", F.length("text")).where(F.col(key).isNotNull() & (F.col("n") >= least))
    docs = docs.withColumn("same", F.unhex(F.md5(F.col("text").cast("binary"))))
    multi = written(docs.groupBy("same").agg(F.min("doc").alias("rep"), F.max("doc").alias("last")).where("rep <> last").select("same", "rep"), "text-classes")
    told = docs.join(broadcast_if_small(multi), "same", "left")
    copies = told.where("rep is not null").select(F.col("doc").alias("doc_id"), F.lit(0).cast("bigint").alias("start_pos"), F.col("n").cast("bigint").alias("end_pos"))
    reps = told.where("rep is null or rep = doc").select("doc", "text")
    names = written(reps.mapInArrow(_kept_batches(least, reveal, PIECE), "name bigint, doc bigint, at bigint"), "span-names")
    zones = written(_in_two(names, ["name"]).groupBy("doc").agg(F.collect_list("at").alias("places")), "span-zones")  # bounded by a text's length
    near = reps.join(broadcast_if_small(zones.select("doc")), "doc", "left_semi").join(zones, "doc").select("doc", "text", "places")
    spans = written(near.mapInArrow(_span_batches(least, reveal, PIECE), "h1 bigint, h2 bigint, doc bigint, at bigint"), "span-spans")
    hits = _in_two(spans, ["h1", "h2"]).select("doc", "at")
    w = Window.partitionBy("doc").orderBy("at")
    hits = hits.withColumn("_new", F.when(F.col("at") <= F.lag("at").over(w) + least, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = hits.groupBy("doc", "_run").agg(F.min("at").alias("start_pos"), (F.max("at") + least).alias("end_pos")).select(F.col("doc").alias("doc_id"), "start_pos", "end_pos")
    # texts with copies are shared as a whole
    runs = runs.join(broadcast_if_small(multi.select(F.col("rep").alias("doc_id"))), "doc_id", "left_anti")
    return runs.unionByName(copies)


def shared_amount(df: DataFrame, key: str, text: str, least: int = 200) -> DataFrame:
    """Per text: characters, shared characters and their share (0 for a text without characters)."""
    sums = shared_spans(df, key, text, least).groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars"))
    got = F.coalesce("shared_chars", F.lit(0).cast("bigint"))
    return docs.join(sums, "doc_id", "left").select("doc_id", "chars", got.alias("shared_chars"), F.round(F.when(F.col("chars") > 0, got / F.col("chars")).otherwise(0.0), 6).alias("share"))

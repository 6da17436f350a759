"""The k most similar vectors of every vector (problem 4), by a hierarchical k-means tree.

The tree has two parts. The upper one divides the rows into cells of about `CELL_ROWS` and is fitted
by the driver on at most `TOP_SAMPLE` rows (a table of up to CELL_ROWS rows is one cell). Below each
cell an executor fits a tree on the cell's own sample, a fixed share of the rows (about
`LEAF_SAMPLE` of them for each leaf, at most `CELL_SAMPLE` a cell), so that leaves hold about
`LEAF_ROWS` rows and their number grows with the rows. Up to `SENT` leaves the centres are broadcast;
beyond, rows and trees meet by a shuffle on the cell, in salted parts. Both ways run the same code on
the same trees and give the same leaves.

Every vector descends to the nearest leaf, and on the way to every branch within a reach; the distance
of a branch is that to the border with the branch taken (the greatest on the way). Deep inside a leaf a
query visits only that one, near borders several. The reach is calibrated: for held-out rows the true neighbours are computed against
all rows, and the reach widened until the wanted share of them lies in visited leaves. Where only
neighbours from a threshold on are asked for, only those count, and more rows are held out, because
few have any. Rows, leaves, visits and recall are printed.

Neighbouring leaves of a cell form blocks of at most `BLOCK_LEAVES` wanted leaves (at least `BLOCKS`
blocks where the rows allow it). A row is shuffled once as data and query of its own block and once per
further block with leaves it visits, as float16 with a bit for each leaf. A task holds the data of one
block and streams its queries past the leaves they visit. Blocks are only a matter of transport: which
leaves meet does not depend on them. A block visited by very many queries is processed in parts, its
data being copied to each. A leaf of more than four times the wanted size, which no centre could divide
(scaled copies), is a block of its own: its rows are divided by hash, its queries look into every part,
and all is in double precision, because codes could not tell its vectors apart. Where neighbours from a threshold on are asked for, the
leading third of the numbers and the lengths of the rest bound the similarity from above, and only
pairs whose bound reaches the threshold are computed. Similarities of codes only choose candidates: the
k best and all that the error of the codes could hide, which are computed again in double precision
before k of them are taken.

Exact copies are one vector: copies are grouped by content first, each distinct vector is searched
once, and copies are brought back per row (the first k + 1 of a group are enough for any row).

Defined cases: null, all-zero, non-finite and wrongly sized vectors are left out; ties go to the
smaller id; an empty table gives nothing; with at most k other vectors all of them are neighbours.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.session import broadcast_if_small, spread, written

#: Wanted rows in a leaf and in a cell of the upper tree.
LEAF_ROWS = 4096
CELL_ROWS = 256 * LEAF_ROWS
#: Rows that the fits see: per leaf, at least and at most below one cell, and for the upper tree.
LEAF_SAMPLE = 64
CELL_SAMPLE = (16_384, 65_536)
TOP_SAMPLE = 65_536
CELLS = 8192
BRANCH = 32
#: Held-out queries of the calibration, for all neighbours and for those from a threshold on.
CALIBRATE = (128, 2048)
#: Leaves whose centres may be broadcast (50 MB of 384 numbers).
SENT = 32_768
#: Leaves of the wanted size in a block at most (200 MB of 384 float16 numbers), and blocks at least.
BLOCK_LEAVES = 64
BLOCKS = 32
#: Queries of a block beyond which it may be processed in parts, of at least so many queries for each row of data.
CROWD = 32 * LEAF_ROWS
CROWD_DATA = 4
#: Ids that may be broadcast without their vectors.
IDS = 2_000_000
#: Reserve below the threshold when candidates are chosen for an exact check.
SLACK = 0.01
#: Standard deviations of the error of a difference of two similarities that candidates may lie below the k-th.
SIGMAS = 6
_SPACE = 1 << 30


# -- the tree ---------------------------------------------------------------------------------------


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    # the first centres are drawn with probability by squared distance to those already drawn
    c = np.empty((k, x.shape[1]), x.dtype)
    c[0], far = x[rng.integers(len(x))], np.full(len(x), np.inf)
    norm = (x * x).sum(1)
    for j in range(1, k):
        far = np.minimum(far, np.maximum(norm - 2 * (x @ c[j - 1]) + c[j - 1] @ c[j - 1], 0))
        c[j] = x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)
        for j in range(k):
            own = x[near == j]
            c[j] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return c


class Tree:
    """Nodes in arrays: centre, first child and number of children (children are neighbours); leaves are numbered."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        centres, first, count, leaf_of = [x.mean(0) if len(x) else np.zeros(x.shape[1], np.float32)], [0], [0], [-1]
        todo, self.leaves, sampled = [(0, x)], 0, []
        while todo:
            node, own = todo.pop()
            k = min(BRANCH, max(2, math.ceil(len(own) / max(1, leaf))))
            c = near = None
            if len(own) > max(leaf, 2 * k):
                c = _kmeans(own, k, rng)
                near = np.argmax(own @ c.T - 0.5 * (c * c).sum(1), 1)
            if near is None or (np.bincount(near, minlength=k) == len(own)).any():  # small enough, or all alike
                leaf_of[node], self.leaves = self.leaves, self.leaves + 1
                sampled.append(len(own))
                continue
            used = [j for j in range(k) if (near == j).any()]
            first[node], count[node] = len(centres), len(used)
            for j in used:
                todo.append((len(centres), own[near == j]))
                centres.append(c[j])
                first.append(0), count.append(0), leaf_of.append(-1)
        self.centres = np.asarray(centres, np.float32)
        self.half = 0.5 * (self.centres.astype(np.float64) ** 2).sum(1)
        self.first, self.count, self.leaf_of = (np.asarray(a, np.int32) for a in (first, count, leaf_of))
        self.sampled = np.asarray(sampled, np.int64)
        self.group(1.0, 1 << 62, 1 << 62, 1)

    def group(self, weight: float, rows: int, dense: int, most: int) -> None:
        """Blocks of leaves that follow each other, of about `rows` rows, a row of the sample standing for `weight`.

        A leaf beyond `dense` rows, which no centre could divide, is a block of its own with parts of `most` rows.
        """
        self.block_of, start, parts, own, held = np.zeros(self.leaves, np.int64), [], [], [], 0.0
        for leaf, size in enumerate(self.sampled * weight):
            alone = size > dense
            if not start or alone or own[-1] or held + size > rows:
                start.append(leaf), parts.append(math.ceil(size / most) if alone else 1), own.append(alone)
                held = 0.0
            held += size
            self.block_of[leaf] = len(start) - 1
        self.start, self.parts, self.dense = np.asarray(start, np.int64), np.asarray(parts, np.int64), np.asarray(own, bool)
        self.wide = int(np.bincount(self.block_of).max())

    def _borders(self, node: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest child of an inner node for each row, and the distance of the row to the border of each other child."""
        kids = slice(self.first[node], self.first[node] + self.count[node])
        c = self.centres[kids].astype(np.float64)
        d = self.half[kids] - x @ c.T  # half the squared distance, but for a constant
        best = d.argmin(1)
        gap = np.sqrt(np.maximum(2 * (self.half[kids][:, None] + self.half[kids][None, :] - c @ c.T), 0))[best]
        far = (d - d[np.arange(len(x)), best][:, None]) / np.where(gap > 0, gap, 1)
        return best, far

    def visits(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, nth, leaf, distance) of the leaves within reach of each row, by distance; the row's own is always the first.

        All rows go on at once, level by level: from an inner node a row steps to the nearest child and
        to all whose border is within reach. Only borders of nodes that are passed are computed, once
        for all rows there.
        """
        row, node, dist, own = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x)), np.ones(len(x), bool)
        out = []
        while len(row):
            end = self.leaf_of[node] >= 0
            out.append((row[end], self.leaf_of[node[end]], dist[end], own[end]))
            order = np.argsort(np.where(end, len(self.leaf_of), node), kind="stable")[: len(row) - int(end.sum())]
            row, node, dist, own = row[order], node[order], dist[order], own[order]
            cuts = np.flatnonzero(np.diff(node)) + 1
            steps = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
            for a, b in zip([0, *cuts], [*cuts, len(node)]):
                if a == b:
                    continue
                best, far = self._borders(node[a], x[row[a:b]])
                far = np.maximum(far, dist[a:b][:, None])
                far[np.arange(b - a), best] = dist[a:b]
                i, kid = np.nonzero(far <= reach) if reach >= 0 else (np.arange(b - a), best)
                steps.append((row[a:b][i], self.first[node[a]] + kid, far[i, kid], own[a:b][i] & (kid == best[i])))
            row, node, dist, own = (np.concatenate(c) for c in zip(*steps))
        if not out:
            return *([np.zeros(0, np.int64)] * 3), np.zeros(0)
        row, leaf, dist, own = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((dist, ~own, row))
        row, leaf, dist = row[order], leaf[order], dist[order]
        return row, np.arange(len(row)) - np.searchsorted(row, row), leaf, dist

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        row, _, leaf, _ = self.visits(x, -1.0)
        got = np.zeros(len(x), np.int64)
        got[row] = leaf
        return got

    def distances(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row of y, and its distance from the row of x as visits has it."""
        at, dist = np.zeros(len(y), np.int64), np.zeros(len(y))
        while len(r := np.flatnonzero(self.leaf_of[at] < 0)):
            for node in np.unique(at[r]):
                own = r[at[r] == node]
                best, _ = self._borders(node, y[own])
                _, far = self._borders(node, x[own])
                dist[own] = np.maximum(dist[own], far[np.arange(len(own)), best])
                at[own] = self.first[node] + best
        return self.leaf_of[at].astype(np.int64), dist


# -- vectors ----------------------------------------------------------------------------------------


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (float64) of the usable rows of a list column, and which rows those are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    ok = np.flatnonzero(sizes == dim)
    x = np.asarray(column.take(pa.array(ok)).flatten().cast(pa.float64()).fill_null(np.nan), np.float64).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good][:, None], ok[good]


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    size = rows.shape[1] * rows.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(rows))])


def _units(codes: np.ndarray) -> np.ndarray:
    """Unit vectors (float32) of float16 codes; float64 ones are as they are."""
    if codes.dtype == np.float64:
        return codes
    x = codes.astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]


def vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v) of rows with an id and `dim` numbers; what else makes a vector unusable is seen where it is read."""
    d = spread(df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")))
    return d.where(F.col("id").isNotNull() & (F.size("v") == dim))


def _digests(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ok = _matrix(batch.column(1), dim)
            raw = np.asarray(batch.column(1).take(pa.array(ok)).flatten(), np.float32).reshape(-1, dim) + np.float32(0)  # no negative zero
            yield pa.record_batch([batch.column(0).take(pa.array(ok)), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in raw], pa.binary())], ["id", "cls"])

    return run


# -- fitting ----------------------------------------------------------------------------------------


class Index:
    """A fitted tree with the reach of a query and the recall measured for it."""

    def __init__(self, top: Tree, subs: dict[int, Tree] | None, table: DataFrame | None, salts: DataFrame | None, rows: int, leaves: int, blocks: int):
        self.top, self.subs, self.table, self.salts, self.rows, self.leaves, self.blocks = top, subs, table, salts, rows, leaves, blocks
        self.reach, self.recall, self.visits, self.crowds = -1.0, 1.0, 1.0, None
        self.shared = table.sparkSession.sparkContext.broadcast((top, subs))

    def _in_cells(self, routed: DataFrame, run, schema: str) -> DataFrame:
        """Rows with a cell and an id meet the tree of their cell, in salted parts."""
        routed = routed.join(F.broadcast(self.salts), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        trees = self.table.join(F.broadcast(self.salts), "cell").select("cell", "blob", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"))
        return routed.groupBy("cell", "salt").cogroup(trees.groupBy("cell", "salt")).applyInArrow(run, schema)

    def place(self, rows: DataFrame, dim: int, reach: float) -> DataFrame:
        """The blocks of the leaves that rows (id, v, ask) visit; rows that ask nothing have their own only.

        leaf and pos: the row's own leaf in the cell and in the block, -1 in other blocks; seen: number of
        visited leaves; mask: a bit for each leaf of the block; part: of a dense leaf.
        """
        schema = "cell bigint, block int, part int, leaf int, pos int, seen int, id bigint, ask boolean, mask binary, code binary"
        if self.subs is not None:
            return rows.select("id", "v", "ask").mapInArrow(_place(self.shared, dim, reach), schema)
        routed = rows.select("id", "v", "ask").mapInArrow(_route(self.shared, dim, reach), "cell bigint, nth int, far double, id bigint, ask boolean, vec binary")
        return self._in_cells(routed, _place_cell(dim, reach), schema)

    def distances(self, pairs: DataFrame, dim: int) -> DataFrame:
        """(far): how far the leaf of y lies from x, for rows (id, x, y) of two vectors."""
        if self.subs is not None:
            return pairs.select("id", "x", "y").mapInArrow(_far(self.shared, dim), "far double")
        routed = pairs.select("id", "x", "y").mapInArrow(_far(self.shared, dim, False), "cell bigint, far double, id bigint, x binary, y binary")
        return self._in_cells(routed, _far_cell(dim), "far double")


def _batch(cell: int, block, part, leaf, pos, seen, ids, asks, mask, x) -> pa.RecordBatch:
    types = [pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.bool_()]
    cols = [pa.array(c, t) for c, t in zip((np.full(len(ids), cell), block, part, leaf, pos, seen, ids, asks), types)]
    return pa.record_batch([*cols, _binary(mask), _binary(x)], ["cell", "block", "part", "leaf", "pos", "seen", "id", "ask", "mask", "code"])


def _reached(tree: Tree, x: np.ndarray, asks: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """visits of the rows that ask, and the own leaf of the others."""
    ask, not_ask = np.flatnonzero(asks), np.flatnonzero(~asks)
    a, b = tree.visits(x[ask], reach), tree.visits(x[not_ask], -1.0)
    return np.concatenate([ask[a[0]], not_ask[b[0]]]), *(np.concatenate([p, q]) for p, q in zip(a[1:], b[1:]))


def _in_cell(tree: Tree, cell: int, nth: np.ndarray, x: np.ndarray, ids: np.ndarray, asks: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
    """The blocks below one cell that rows visit; nth is the place of the cell among those of the row. Vectors of dense leaves go as they are."""
    row, j, leaf, _ = _reached(tree, x, asks, reach)
    home = (nth[row] == 0) & (j == 0)
    key, at = np.unique(row * len(tree.start) + tree.block_of[leaf], return_inverse=True)
    row, block = key // len(tree.start), key % len(tree.start)
    bits = np.zeros((len(key), tree.wide), bool)
    bits[at, leaf - tree.start[block[at]]] = True
    own = np.full(len(key), -1)
    own[at[home]] = leaf[home]
    # queries look into all parts of a leaf, and a row is data of one
    copies = np.where(asks[row] | (own < 0), tree.parts[block], 1)
    entry = np.repeat(np.arange(len(key)), copies)
    part = np.arange(len(entry)) - np.repeat(np.cumsum(copies) - copies, copies)
    row, block, own, seen = row[entry], block[entry], own[entry], np.where(part == 0, bits.sum(1)[entry], 0)
    data = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tree.parts[block]
    part = np.where(asks[row], part, data)
    own = np.where(part == data, own, -1)
    columns = block, part, own, np.where(own < 0, -1, own - tree.start[block]), seen, ids[row], asks[row], np.packbits(bits, 1)[entry]
    for which, kind in ((~tree.dense[block], np.float16), (tree.dense[block], np.float64)):
        if which.any():
            yield _batch(cell, *(c[which] for c in columns), x[row[which]].astype(kind))


def _by_cell(cell: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for c in np.unique(cell):
        yield int(c), np.flatnonzero(cell == c)


def _place(shared, dim: int, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, subs = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x, ok = _matrix(part.column(1), dim)
                ids, asks = np.asarray(part.column(0))[ok], np.asarray(part.column(2))[ok].astype(bool)
                row, nth, cell, _ = _reached(top, x, asks, reach)
                for c, own in _by_cell(cell):
                    r = row[own]
                    yield from _in_cell(subs[c], c, nth[own], x[r], ids[r], asks[r], reach)

    return run


def _route(shared, dim: int, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, _ = shared.value
        for batch in batches:
            x, ok = _matrix(batch.column(1), dim)
            ids, asks = np.asarray(batch.column(0))[ok], np.asarray(batch.column(2))[ok].astype(bool)
            row, nth, cell, far = _reached(top, x, asks, reach)
            yield pa.record_batch([pa.array(cell, pa.int64()), pa.array(nth, pa.int32()), pa.array(far), pa.array(ids[row]), pa.array(asks[row]), _binary(x[row])], ["cell", "nth", "far", "id", "ask", "vec"])

    return run


def _doubles(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _place_cell(dim: int, reach: float):
    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            tree, cell = pickle.loads(trees["blob"][0].as_py()), rows["cell"][0].as_py()
            for part in rows.to_batches(2048):
                out.extend(_in_cell(tree, cell, np.asarray(part.column("nth")), _doubles(part.column("vec"), dim), np.asarray(part.column("id")), np.asarray(part.column("ask")).astype(bool), reach))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_batch(0, *[np.zeros(0, np.int64)] * 6, np.zeros(0, bool), np.zeros((0, 1), np.uint8), np.zeros((0, dim), np.float16))])

    return run


def _far(shared, dim: int, whole: bool = True):
    """Distances of whole trees, or to the cell only, with what is needed to go on in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, subs = shared.value
        for batch in batches:
            (x, ok), (y, also) = _matrix(batch.column(1), dim), _matrix(batch.column(2), dim)
            assert len(ok) == len(also)
            cell, far = top.distances(x, y)
            if whole:
                for c, own in _by_cell(cell):
                    far[own] = np.maximum(far[own], subs[c].distances(x[own], y[own])[1])
                yield pa.record_batch([pa.array(far)], ["far"])
            else:
                yield pa.record_batch([pa.array(cell), pa.array(far), batch.column(0), _binary(x), _binary(y)], ["cell", "far", "id", "x", "y"])

    return run


def _far_cell(dim: int):
    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        far = np.zeros(0)
        if rows.num_rows:
            far = np.maximum(np.asarray(rows["far"]), pickle.loads(trees["blob"][0].as_py()).distances(_doubles(rows["x"], dim), _doubles(rows["y"], dim))[1])
        return pa.table({"far": pa.array(far, pa.float64())})

    return run


def _fit_cell(dim: int, leaf: int, share: float, *sizes: int):
    def run(tab: pa.Table) -> pa.Table:
        x, _ = _matrix(tab.sort_by("id")["v"], dim)  # the same tree in whatever order rows arrive
        tree = Tree(x.astype(np.float32), leaf)
        tree.group(1 / (share * tab["keep"][0].as_py()), *sizes)
        return pa.table({"cell": pa.array([tab["cell"][0].as_py()], pa.int64()), "blob": pa.array([pickle.dumps(tree)], pa.binary()), "leaves": pa.array([tree.leaves], pa.int64()), "blocks": pa.array([len(tree.start)], pa.int64())})

    return run


def _with_cells(top, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _matrix(batch.column(1), dim)
            yield pa.record_batch([pa.array(top.value.homes(x), pa.int64()), batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok))], ["cell", "id", "v"])

    return run


def _picked(hashed: DataFrame, rows: int, share: float, last: bool = False) -> pa.Table:
    """About the `rows` rows with the least (or greatest) hashes, of which a share of all is looked at."""
    h = F.col("_h")
    some = hashed.where(h >= int((1 - share) * _SPACE)) if last else hashed.where(h < int(share * _SPACE) + 1)
    return some.orderBy(F.desc("_h") if last else "_h", "id").limit(rows).select("id", "v").toArrow()


def fit(rows: DataFrame, dim: int, k: int, recall: float, least: float | None = None) -> Index:
    """Fit and calibrate on (id, v) rows, for the k nearest or for those of them at `least` or above."""
    spark = rows.sparkSession
    n, asks = rows.count(), CALIBRATE[least is not None]
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(_SPACE)))
    held = min(0.25, 3 * asks / max(1, n))  # held out from the fits
    cells = min(CELLS, -(-n // CELL_ROWS))
    none = np.zeros((0, dim), np.float32)
    if cells > 1:
        wanted = min(TOP_SAMPLE, LEAF_SAMPLE * cells)
        x, _ = _matrix(_picked(hashed, wanted, min(1 - held, 1.2 * wanted / n + 1000 / n))["v"], dim)
        top = Tree(x.astype(np.float32), max(4, len(x) // cells))
    else:
        top = Tree(none, 1)
    # the share of the rows that the fits below the cells see
    share = min(1 - held, max(LEAF_SAMPLE / LEAF_ROWS, CELL_SAMPLE[0] * cells / max(1, n)), max(1.0, CELL_SAMPLE[1] * cells / max(1, n)))
    share = min(share, CELL_SAMPLE[1] * cells / max(1, n)) if n else 1.0
    sample = hashed.where(F.col("_h") < int(share * _SPACE)).select("id", "v")
    told = sample.mapInArrow(_with_cells(spark.sparkContext.broadcast(top), dim), "cell bigint, id bigint, v array<float>")
    sizes = told.groupBy("cell").count().toPandas()  # at most CELLS rows
    crowded = sizes[sizes["count"] > 2 * CELL_SAMPLE[1]]
    told = told if len(crowded) else told.withColumn("keep", F.lit(1.0))
    if len(crowded):  # cells that the upper tree could not divide
        few = spark.createDataFrame([(int(c), float(2 * CELL_SAMPLE[1] / m)) for c, m in zip(crowded["cell"], crowded["count"])], "cell bigint, keep double")
        told = told.join(F.broadcast(few), "cell", "left").withColumn("keep", F.coalesce("keep", F.lit(1.0))).where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(_SPACE)) < F.col("keep") * _SPACE)
    leaf = max(8, round(share * LEAF_ROWS))
    most = BLOCK_LEAVES * LEAF_ROWS
    block = min(most, max(LEAF_ROWS, n // BLOCKS))
    table = written(told.groupBy("cell").applyInArrow(_fit_cell(dim, leaf, share, block, 4 * LEAF_ROWS, max(1, most // 8)), "cell bigint, blob binary, leaves bigint, blocks bigint"), "vector-trees")
    missing = [(c, pickle.dumps(Tree(none, 1)), 1, 1) for c in range(top.leaves) if c not in set(sizes["cell"])]
    table = table.unionByName(spark.createDataFrame(missing, table.schema)) if missing else table
    leaves, blocks = table.agg(F.sum("leaves"), F.sum("blocks")).first()
    subs = {r["cell"]: pickle.loads(r["blob"]) for r in table.collect()} if leaves <= SENT else None
    counts = {int(c): float(m) for c, m in zip(sizes["cell"], sizes["count"])}
    salts = spark.createDataFrame([(c, max(1, math.ceil(counts.get(c, 0) / share / 32_768))) for c in range(top.leaves)], "cell bigint, salts bigint")
    index = Index(top, subs, table, salts, n, leaves, blocks)
    if leaves > 1:
        if recall >= 1:
            index.reach = math.inf  # all leaves
        else:
            _calibrate(index, rows, _picked(hashed, asks, held, last=True), dim, k, recall, least)
        _crowds(index, sample, share, dim)
    print(f"neighbours: {n} rows, {top.leaves} cells, {leaves} leaves, {blocks} blocks; a query visits {index.visits:.2f} on average, recall {index.recall:.4f} on held-out rows", file=sys.stderr)
    return index


def _tops(shared, k: int, dim: int, least: float):
    """The k nearest of each calibration query in a partition, from `least` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        q = q.astype(np.float32)
        best_s, best_v = np.full((len(ids), k), -2.0, np.float32), np.zeros((len(ids), k, dim), np.float32)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x, ok = _matrix(part.column(1), dim)
                x = x.astype(np.float32)
                sim = q @ x.T
                sim[ids[:, None] == np.asarray(part.column(0))[ok][None, :]] = -2
                hit = sim > np.maximum(best_s.min(1), least)[:, None]  # few after the first rows
                for i in np.flatnonzero(hit.any(1)):
                    c = np.flatnonzero(hit[i])
                    sims, vecs = np.concatenate([best_s[i], sim[i, c]]), np.concatenate([best_v[i], x[c]])
                    keep = np.argpartition(-sims, k - 1)[:k]
                    best_s[i], best_v[i] = sims[keep], vecs[keep]
        i, j = np.nonzero(best_s > -1.5)
        flat = pa.array(best_v[i, j].reshape(-1), pa.float32())
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(best_s[i, j], pa.float32()), pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * dim, pa.int32()), flat)], ["q", "sim", "v"])

    return run


def _calibrate(index: Index, rows: DataFrame, picked: pa.Table, dim: int, k: int, recall: float, least: float | None) -> None:
    spark = rows.sparkSession
    q, ok = _matrix(picked["v"], dim)
    ids = np.asarray(picked["id"])[ok]
    if not len(q):
        return
    shared = spark.sparkContext.broadcast((ids, q))
    got = rows.select("id", "v").mapInArrow(_tops(shared, k, dim, -1.5 if least is None else least), "q int, sim float, v array<float>")
    true = got.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim")))).where(F.col("r") <= k)
    flat = pa.array(q.reshape(-1).astype(np.float32))
    asked = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(q)), pa.int32()), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * dim, pa.int32()), flat)}))
    pairs = true.join(F.broadcast(asked), "q").select(F.col("q").cast("bigint").alias("id"), "x", F.col("v").alias("y"))  # at most k rows a query
    far = np.sort(index.distances(pairs, dim).toPandas()["far"].to_numpy())
    if len(far):
        index.reach = float(far[max(0, math.ceil(recall * len(far)) - 1)])
        index.recall = float((far <= index.reach).mean())


def _crowds(index: Index, sample: DataFrame, share: float, dim: int) -> None:
    """Visits of a row on average and the blocks that must be processed in parts, (cell, block, part, crowd), estimated on the sample."""
    placed = index.place(sample.withColumn("ask", F.lit(True)), dim, index.reach)
    home = F.col("leaf") >= 0
    g = placed.groupBy("cell", "block", "part").agg((F.count(F.lit(1)) / share).alias("asks"), (F.count_if(home) / share).alias("data"), (F.sum("seen") / share).alias("seen"))
    g = written(g, "block-sizes")
    each = F.greatest(F.lit(float(CROWD)), CROWD_DATA * F.col("data"))
    got = g.select("cell", "block", "part", F.ceil(F.col("asks") / each).cast("int").alias("crowd")).where("crowd > 1")
    total = g.agg(F.sum("seen"), F.sum("data")).first()
    index.visits = (total[0] or 0) / max(1.0, total[1] or 0)
    index.crowds = got if got.limit(1).count() else None


# -- searching --------------------------------------------------------------------------------------

DATA_AND_QUERY, DATA, QUERY = 0, 1, 2


def _fourth(x: np.ndarray) -> np.ndarray:
    return (x**4).sum(1) ** 0.25


class _Block:
    """The data of a block, leaf after leaf, as codes, and their leading numbers with the length of the rest."""

    def __init__(self, codes: np.ndarray, own: np.ndarray, pos: np.ndarray, k: int, floor: float):
        self.codes, self.own, self.k, self.floor, self.lead = codes, own, k, floor, max(1, codes.shape[1] // 3)
        cuts = np.flatnonzero(np.diff(pos, prepend=-1))
        self.slices = [(int(pos[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(pos)])]
        self.by_id = np.argsort(self.own, kind="stable")
        self.short = np.zeros((len(own), self.lead + 1), np.float32) if floor > 0 else None
        fourth = 0.0
        for a in range(0, len(own), 4096):
            x = _units(codes[a : a + 4096])
            fourth = max(fourth, float(_fourth(x).max()))
            if self.short is not None:
                self.short[a : a + 4096] = self.shorten(x)
        self.error = SIGMAS * math.sqrt(2) * math.sqrt(2 / 3) * 2**-11 * fourth

    def shorten(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x[:, : self.lead], np.sqrt((x[:, self.lead :] ** 2).sum(1))[:, None]])

    def ask(self, q: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(q), 1024):
            yield self._ask(*(a[start : start + 1024] for a in (q, ids, bits)))

    def _ask(self, q: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        """Of each query the k best of the visited leaves and those within `reserve` of the k-th, from the floor on."""
        n, k = len(q), self.k
        best = np.full((n, k), -2.0, np.float32)
        reserve = np.minimum(self.error * _fourth(q), 2**-9).astype(np.float32)
        bound = np.full(n, max(self.floor, -1.5), np.float32)
        short = self.shorten(q) if self.short is not None else None
        at = np.minimum(np.searchsorted(self.own, ids, sorter=self.by_id), len(self.own) - 1)
        itself = np.where(self.own[self.by_id[at]] == ids, self.by_id[at], -1)
        found: list[tuple] = []
        for pos, a, b in self.slices:
            r = np.flatnonzero(bits[:, pos])
            if not len(r):
                continue
            row = None
            if short is not None:
                # what the bound excludes cannot reach the floor or the k-th
                row, col = np.nonzero(short[r] @ self.short[a:b].T >= bound[r][:, None] - 1e-5)
                if len(row) > 0.03 * len(r) * (b - a):
                    row = None
            if row is None:
                sim = q[r] @ _units(self.codes[a:b]).T
                me = np.flatnonzero((itself[r] >= a) & (itself[r] < b))
                sim[me, itself[r[me]] - a] = -2
                m = min(k, b - a)
                if (sim >= bound[r][:, None]).sum() > 4 * k * len(r):
                    top = -np.partition(-sim, m - 1, 1)[:, :m]
                    bound[r] = np.maximum(bound[r], -np.partition(-np.hstack([best[r], top]), k - 1, 1)[:, k - 1] - reserve[r])
                row, col = np.nonzero(sim >= bound[r][:, None])
                sims, row, col = sim[row, col], r[row], col + a
            else:
                row, col = r[row], col + a
                other = col != itself[row]
                row, col = row[other], col[other]
                sims = np.concatenate([np.zeros(0, np.float32), *(np.einsum("ij,ij->i", q[row[i : i + 8192]], _units(self.codes[col[i : i + 8192]])) for i in range(0, len(row), 8192))])
                near = sims >= bound[row]
                row, col, sims = row[near], col[near], sims[near]
            if len(row):
                found.append((row, col, sims))
                # the k best so far of the queries that found something
                who = np.unique(row)
                of, what = np.concatenate([np.repeat(who, k), row]), np.concatenate([best[who].ravel(), sims])
                order = np.lexsort((-what, of))
                of, what = of[order], what[order]
                rank = np.arange(len(of)) - np.searchsorted(of, of)
                best[of[rank < k], rank[rank < k]] = what[rank < k]
                bound[who] = np.maximum(bound[who], best[who, k - 1] - reserve[who])
        row, col, sims = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        keep = sims >= bound[row]
        row, col, sims = row[keep], col[keep], sims[keep]
        return pa.record_batch([pa.array(ids[row], pa.int64()), pa.array(self.own[col], pa.int64()), pa.array(sims, pa.float32()), pa.array(reserve[row], pa.float32())], ["a", "b", "sim", "reserve"])


class _Dense:
    """The data of a part of a dense leaf, in double precision: similarities that differ by rounding only are ties."""

    def __init__(self, x: np.ndarray, own: np.ndarray, k: int, floor: float):
        order = np.argsort(own, kind="stable")
        self.x, self.own, self.k, self.floor = x[order], own[order], k, floor

    def ask(self, q: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of each query the k best, the smaller ids among equals."""
        for start in range(0, len(q), 256):
            of = ids[start : start + 256]
            sim = np.round(q[start : start + 256] @ self.x.T, 12)
            sim[of[:, None] == self.own[None, :]] = -2
            m = min(self.k, sim.shape[1])
            kth = -np.partition(-sim, m - 1, 1)[:, m - 1 : m]
            above, equal = sim > kth, sim == kth
            keep = above | (equal & (np.cumsum(equal, 1, dtype=np.int32) <= m - above.sum(1)[:, None]))
            row, col = np.nonzero(keep & (sim >= max(self.floor, -1.5)))
            # beside similarities of codes they count with the greatest error of those
            yield pa.record_batch([pa.array(of[row], pa.int64()), pa.array(self.own[col], pa.int64()), pa.array(sim[row, col].astype(np.float32)), pa.array(np.full(len(row), 2**-9, np.float32))], ["a", "b", "sim", "reserve"])


def _codes(column: pa.Array, kind, size: int) -> np.ndarray:
    """The numbers of a binary column whose values have equal length."""
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], kind, len(column) * size, start).reshape(-1, size)


def _search(k: int, dim: int, floor: float):
    """For rows sorted by block, part and leaf, queries last: of each query the k best of the data and those within `reserve` of the k-th, from `floor` on.

    Rounding to float16 changes each number by up to 2**-11 of it, evenly distributed; so the error of a
    similarity has a standard deviation of at most sqrt(2 / 3) * 2**-11 times the product of the 4-norms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data, ready = None, [], None

        def close():
            """The data of the block, and the answers to its own queries."""
            own, pos, asks, bits = (np.concatenate([d[i] for d in data]) for i in range(1, 5))
            codes, end = np.empty((len(own), dim), data[0][0].dtype), len(own)
            while data:  # each piece is freed when it is copied
                piece = data.pop()[0]
                codes[end - len(piece) : end], end = piece, end - len(piece)
            asks = np.flatnonzero(asks)
            block = _Block(codes, own, pos, k, floor) if codes.dtype == np.float16 else _Dense(codes, own, k, floor)

            def answers():
                for i in range(0, len(asks), 8192):
                    which = asks[i : i + 8192]
                    yield from block.ask(_units(codes[which]), own[which], bits[which])

            return block, answers()

        for batch in batches:
            group = np.stack([np.asarray(batch.column(i), np.int64) for i in range(4)], 1)  # cell, block, part, crowd
            role, ids, pos = np.asarray(batch.column(4)), np.asarray(batch.column(5)), np.asarray(batch.column(6))
            runs = np.column_stack([group, role == QUERY])
            cuts = np.flatnonzero((runs[1:] != runs[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if a == b:
                    continue
                if tuple(group[a]) != now:
                    if data:
                        yield from close()[1]
                    now, data, ready = tuple(group[a]), [], None
                masks, codes = batch.column(7).slice(a, b - a), batch.column(8).slice(a, b - a)
                bits = np.unpackbits(_codes(masks, np.uint8, len(masks[0].as_py())), axis=1).astype(bool)
                kind = np.float16 if len(codes[0].as_py()) == 2 * dim else np.float64
                if role[a] != QUERY:
                    data.append((_codes(codes, kind, dim).copy(), ids[a:b], pos[a:b], role[a:b] == DATA_AND_QUERY, bits))
                    continue
                if data:
                    ready, own = close()
                    yield from own
                if ready is not None:
                    yield from ready.ask(_units(_codes(codes, kind, dim)), ids[a:b], bits)
        if data:
            yield from close()[1]

    return run


def nearest(rows: DataFrame, dim: int, k: int, index: Index, queries: DataFrame | None = None, floor: float = -2.0) -> DataFrame:
    """(a, b): candidates for the k best b of each a among (id, v) rows, by similarities of float16 codes from `floor` on.

    All that lie below the k-th by no more than the error of the codes are among them.
    queries: ids that are queries; without it all rows are.
    """
    marked = rows.select("id", "v", F.lit(True).alias("ask"))
    if queries is not None:
        marked = rows.select("id", "v").join(broadcast_if_small(queries.withColumn("ask", F.lit(True)), IDS), "id", "left").select("id", "v", F.coalesce("ask", F.lit(False)).alias("ask"))
    placed = index.place(marked, dim, index.reach)
    home = F.col("leaf") >= 0
    role = F.when(home & F.col("ask"), DATA_AND_QUERY).when(home, DATA).otherwise(QUERY)
    columns = ["cell", "block", "part", "crowd", "role", "id", "pos", "mask", "code"]
    placed = placed.withColumn("crowd", F.lit(0)).withColumn("role", role.cast("tinyint")).select(columns)
    if index.crowds is not None:
        placed = placed.drop("crowd").join(broadcast_if_small(index.crowds), ["cell", "block", "part"], "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("id"), F.col("crowd")).cast("int"), F.lit(0)))
        # data of a visited block go to all its crowds, and ask in one of them
        copies = F.when(F.col("crowd").isNotNull() & (F.col("role") != QUERY), F.sequence(F.lit(0), F.col("crowd") - 1)).otherwise(F.array("own"))
        placed = placed.withColumn("crowd", F.explode(copies))
        placed = placed.withColumn("role", F.when((F.col("role") == DATA_AND_QUERY) & (F.col("crowd") != F.col("own")), F.lit(DATA)).otherwise(F.col("role")).cast("tinyint")).select(columns)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(index.leaves, max(4 * cores, index.blocks)))
    number = (F.col("cell") * 7919 + F.col("block") + F.col("part") * 104_729 + F.col("crowd") * 15_485_863) % parts  # one block, or a few, to a task
    sorted_rows = placed.repartitionById(parts, number.cast("int")).sortWithinPartitions("cell", "block", "part", "crowd", F.desc("pos"))
    got = sorted_rows.mapInArrow(_search(k, dim, floor), "a bigint, b bigint, sim float, reserve float")
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    got = got.withColumn("r", F.row_number().over(w)).withColumn("kth", F.min(F.when(F.col("r") <= k, F.col("sim"))).over(Window.partitionBy("a")))
    return got.where(F.col("sim") >= F.col("kth") - F.col("reserve")).select("a", "b").distinct()


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.asarray(batch.column(i).flatten(), np.float64).reshape(-1, dim) for i in (2, 3))
            dot = lambda p, q: np.einsum("ij,ij->i", p, q)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)))], ["a", "b", "sim"])

    return run


def _exact(pairs: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """The pairs with their similarity in double precision; up to IDS ids on a side only their vectors move."""

    def vecs(name: str) -> DataFrame:
        need = pairs.select(F.col(name).alias("id")).distinct()
        some = rows.join(F.broadcast(need), "id", "left_semi") if need.limit(IDS + 1).count() <= IDS else rows
        return some.select(F.col("id").alias(name), F.col("v").alias(f"v{name}"))

    return pairs.join(vecs("a"), "a").join(vecs("b"), "b").select("a", "b", "va", "vb").mapInArrow(_cosines(dim), "a bigint, b bigint, sim double")


def _classes(ids: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every row, and (rep, other): the first k + 1 rows of each class by id.

    Only ids and hashes are shuffled; a class of any size is first cut down in salted parts.
    """
    multi = written(ids.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "vector-classes")
    members = written(ids.join(broadcast_if_small(multi), "cls", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.col("rep").isNotNull().alias("multi")), "vector-members")
    part = Window.partitionBy("rep", F.pmod("id", F.lit(64))).orderBy("id")
    first = members.where("multi").withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    few = members.where("not multi").select("rep", F.col("id").alias("other")).unionByName(first.select("rep", F.col("id").alias("other")))
    return members, few


def similar_rows(df: DataFrame, key: str, vector: str, dim: int, k: int = 10, recall: float = 0.99, least: float | None = None, ask: Column | None = None) -> DataFrame:
    """(a, b, sim): the k most similar other rows b of each row a, or those of them at `least` or above.

    recall: the share of true neighbours that the visited leaves of held-out rows must hold; 1 visits all leaves.

    ask: a condition on `id`; only rows that meet it are queries, all rows are data. Similarities are
    computed in double precision.
    """
    rows = vectors(df, key, vector, dim)
    members, few = _classes(written(rows.mapInArrow(_digests(dim), "id bigint, cls binary"), "vector-digests"), k)
    asked = members if ask is None else members.where(ask)
    copies = members.where("id <> rep").select("id")
    reps = rows.join(broadcast_if_small(copies, IDS), "id", "left_anti").select("id", "v")
    index = fit(reps, dim, k, recall, least)
    queries = None if ask is None else asked.select(F.col("rep").alias("id")).distinct()
    near = _exact(written(nearest(reps, dim, k, index, queries, -2.0 if least is None else least - SLACK), "vector-pairs"), reps, dim)
    if least is not None:
        near = near.where(F.col("sim") >= least)
    # per class the first k + 1 candidates, copies of the class itself among them; a row leaves itself out
    own = asked.where("multi").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("sim")).distinct()
    cand = near.select("a", "b", "sim").unionByName(own).join(few.withColumnRenamed("rep", "b"), "b")
    cand = cand.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "other"))).where(F.col("r") <= k + 1)
    cand = asked.select(F.col("id").alias("row"), F.col("rep").alias("a")).join(cand, "a").where("row <> other")
    best = Window.partitionBy("row").orderBy(F.desc("sim"), "other")
    return cand.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select(F.col("row").alias("a"), F.col("other").alias("b"), "sim")

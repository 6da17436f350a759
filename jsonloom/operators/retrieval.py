"""Exact vector ranking with filters, and context assembly under a token budget.

Rankings here are for a given query vector or a small stated set of them; for every vector of a
collection against all others there is an index elsewhere.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.functions.keys import iso_micros
from jsonloom.operators.relations import expand
from jsonloom.session import written

#: Query vectors that go to the workers at once.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a null, zero or differently long vector."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return F.when(F.size(a) == F.size(b), F.sqrt(d))


def nearest(rows: DataFrame, vector: str, query: list[float], k: int = 3, metric: str = "cosine", where: Column | None = None, tie: str = "id") -> DataFrame:
    """The k rows nearest to one query vector among those that meet `where`, with distance and relevance."""
    q = F.array(*map(F.lit, map(float, query)))
    d = 1 - cosine(F.col(vector), q) if metric == "cosine" else l2(F.col(vector), q)
    rows = rows.where(F.col(vector).isNotNull() if where is None else F.col(vector).isNotNull() & where)
    return rows.withColumn("distance", d).where("distance is not null").withColumn("relevance", 1 - F.col("distance")).orderBy("distance", tie).limit(k)


def nearest_each(queries: DataFrame, rows: DataFrame, k: int = 3, metric: str = "cosine") -> DataFrame:
    """(q, id, distance, rank): for each row (q, qv) of a stated query set the k nearest of (id, v), itself left out.

    A query set of at most `BLOCK` vectors goes to the workers as a whole; a larger one, and the rows,
    are cut into blocks by hash, and each block of queries meets each block of rows in a task of
    bounded size. Each keeps its own k best per query, so only those are shuffled. Rows whose vector
    is null, of another length or, for cosine, all zero are nobody's neighbours. Distances are double;
    ties go to the smaller id.
    """
    q, r = queries.select("q", "qv").where("qv is not null"), rows.select("id", "v").where("v is not null")
    n = q.count()
    if n <= BLOCK:
        held = q.toArrow()  # at most BLOCK vectors
        shared = rows.sparkSession.sparkContext.broadcast((np.asarray(held["q"], np.int64), held["qv"].to_pylist()))

        def run(batches):
            yield from _best(*shared.value, batches, k, metric)

        got = r.mapInArrow(run, "q bigint, id bigint, distance double")
    else:
        n_q, n_r = -(-n // BLOCK), max(1, -(-r.count() // (16 * BLOCK)))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        a = q.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int")).withColumn("c", every(n_r))
        d = r.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(n_r)).cast("int")).withColumn("b", every(n_q))

        def meet(x: pa.Table, y: pa.Table) -> pa.Table:
            return pa.Table.from_batches(_best(np.asarray(x["q"], np.int64), x["qv"].to_pylist(), y.select(["id", "v"]).to_batches(), k, metric), schema=_NEAR)

        got = a.groupBy("b", "c").cogroup(d.groupBy("b", "c")).applyInArrow(meet, "q bigint, id bigint, distance double")
    w = Window.partitionBy("q").orderBy("distance", "id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_NEAR = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def _best(ids: np.ndarray, vectors: list, batches, k: int, metric: str) -> list[pa.RecordBatch]:
    """The k nearest rows (id, v) of the batches for each query vector."""
    best = {}
    for dim in sorted({len(v) for v in vectors} - {0}):
        own = [i for i, v in enumerate(vectors) if len(v) == dim]
        best[dim] = [ids[own], np.array([vectors[i] for i in own], np.float64), np.full((len(own), 0), np.inf), np.zeros((len(own), 0), np.int64)]
    for batch in batches:
        sizes = np.asarray(batch.column(1).value_lengths().fill_null(-1))
        for dim, state in best.items():
            of, x, best_d, best_i = state
            ok = pa.array(np.flatnonzero(sizes == dim))
            if not len(ok):
                continue
            own, y = np.asarray(batch.column(0).take(ok), np.int64), np.asarray(batch.column(1).take(ok).flatten().fill_null(np.nan), np.float64).reshape(-1, dim)
            if metric == "cosine":
                size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = np.where(size > 0, 1 - (x @ y.T) / size, np.inf)
            else:
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))
            d = np.where((of[:, None] == own[None, :]) | np.isnan(d), np.inf, np.round(d, 9))
            d, i = np.hstack([best_d, d]), np.hstack([best_i, np.broadcast_to(own, (len(of), len(own)))])
            order = np.lexsort((i, d), axis=1)[:, :k]
            state[2:] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
    out = []
    for of, _, d, i in best.values():
        q, n = np.nonzero(np.isfinite(d))
        out.append(pa.record_batch([pa.array(of[q]), pa.array(i[q, n]), pa.array(d[q, n])], schema=_NEAR))
    return out


def hybrid_search(chunks: DataFrame, edges: DataFrame, query: list[float], k: int = 3, related: int = 3, depth: int = 2, where: Column | None = None, least: float = 0.0) -> DataFrame:
    """(seed, chunk, role, place, distance): the k chunks (id, v) nearest to a query, and what edges lead to from them.

    Edges (source, target, confidence ...) below `least` are left out; each seed brings at most
    `related` chunks within `depth` steps, nearer ones first. The seeds are k rows, so the graph is
    only followed from them.
    """
    seeds = nearest(chunks, "v", query, k, where=where).select("id", "distance")
    w = Window.orderBy("distance", "id")  # over the k seeds
    seeds = written(seeds.withColumn("place", F.row_number().over(w)), "seeds")
    own = seeds.select(F.col("id").alias("seed"), F.col("id").alias("chunk"), F.lit("base").alias("role"), "place", "distance")
    step = edges.where(F.col("confidence") >= least)
    got = expand(step, seeds.select(F.col("id").alias("chunk")), depth, related)
    held = chunks.select(F.col("id").alias("chunk"))
    more = got.join(held, "chunk", "left_semi").select("seed", "chunk", F.lit("related").alias("role"), F.col("depth").alias("place"), F.lit(None).cast("double").alias("distance"))
    return own.unionByName(more)


def context_needs(nodes: DataFrame) -> DataFrame:
    """One row: distinct identifiers at any depth and the time span of members named after a time, from the node table."""
    ident = (F.col("member") == "id") | F.col("member").endswith("_id")
    stamp = F.when(F.col("member").rlike("time|date"), iso_micros(F.col("value")))
    return nodes.where("kind in ('string', 'int')").agg(F.count_distinct(F.when(ident, F.col("value"))).alias("identifiers"), F.min(stamp).alias("first_at"), F.max(stamp).alias("last_at"))


# Least score of a band and the share of the budget that is used up when the band stops.
BANDS = [("Primary Information", 0.8, 0.7), ("Supporting Information", 0.6, 0.9), ("Additional Context", None, 1.0)]


#: Ranges of ordinals in which tokens are summed first.
RANGES = 4096


def assemble_context(chunks: DataFrame, group: list[str], budget: int = 8000) -> DataFrame:
    """The chunks (text, score, ordinal) of each group that fit its token budget, with band and running tokens.

    Bands go from the best scores on. A chunk is taken if the tokens before it, those of earlier
    bands included, are below the band's limit, so each band may overshoot by one chunk. Tokens are
    summed over ranges of ordinals first, and only ranges that begin below the budget are looked at
    chunk by chunk, so a group of any size is never sorted as a whole.
    """
    score = F.coalesce("score", F.lit(0.0))
    band = F.when(score >= BANDS[0][1], 0).when(score >= BANDS[1][1], 1).otherwise(2)
    c = chunks.withColumn("band", band).withColumn("tokens", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")))
    low, high = c.agg(F.min("ordinal"), F.max("ordinal")).first()
    width = max(1.0, ((high or 0) - (low or 0)) / RANGES)
    c = c.withColumn("_range", F.floor((F.col("ordinal") - F.lit(low or 0)) / width).cast("bigint"))
    by = [*group, "band", "_range"]
    sums = c.groupBy(*by).agg(F.sum("tokens").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*group, "band").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = sums.withColumn("_before", before).where(F.col("_before") < budget).select(*[F.col(x).alias(f"_{x}_") for x in by])
    c = c.join(near, reduce(lambda p, q: p & q, [F.col(x).eqNullSafe(F.col(f"_{x}_")) for x in by]), "left_semi").drop("_range")
    w = Window.partitionBy(*group, "band").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_in", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    limits = [int(budget * 0.7), int(budget * 0.7) + int(budget * 0.2), budget]
    # tokens taken by a band: up to and with the chunk at which its limit is reached
    t0 = F.max(F.when((F.col("band") == 0) & (F.col("_in") < limits[0]), F.col("_in") + F.col("tokens"))).over(Window.partitionBy(*group))
    c = c.withColumn("_t0", F.coalesce(t0, F.lit(0)))
    t1 = F.max(F.when((F.col("band") == 1) & (F.col("_t0") + F.col("_in") < limits[1]), F.col("_in") + F.col("tokens"))).over(Window.partitionBy(*group))
    c = c.withColumn("_t1", F.coalesce(t1, F.lit(0)))
    before = F.when(F.col("band") == 0, F.col("_in")).when(F.col("band") == 1, F.col("_t0") + F.col("_in")).otherwise(F.col("_t0") + F.col("_t1") + F.col("_in"))
    limit = F.when(F.col("band") == 0, limits[0]).when(F.col("band") == 1, limits[1]).otherwise(limits[2])
    name = F.element_at(F.array(*[F.lit(n) for n, _, _ in BANDS]), F.col("band") + 1)
    return c.withColumn("tokens_before", before).where(F.col("tokens_before") < limit).withColumn("section", name).drop("_in", "_t0", "_t1")

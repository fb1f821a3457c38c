"""Operator 3: exact top-k search by distributed histogram selection.

Every candidate is scored against a chunk of queries in each pass, block by block.  Global score
histograms are refined until the bin that holds a query's k-th value is one value wide or holds few
scores; the last pass keeps the scores at or above it, and ties go to the smaller id.

A task that has already seen k scores of a query knows that the global k-th value is no lower than
its own, so it sends only the histogram bins from there up: at most k + 1 rows per query and task.
"""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import best_per_query, cut, finite_vectors, fit_width, query_chunks, vector_blocks

BINS = 1024
BLOCK = 4096
CHUNK_BYTES = 1 << 20
LONG = (-(1 << 63), (1 << 63) - 1)
LARGEST = np.finfo(np.float64).max


def _integers(m: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), kept as doubles; products beyond a double saturate."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(m * scale, -LARGEST, LARGEST))


def _scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products (rows of c x rows of q) as int64; beyond a long they saturate."""
    width = max(c.shape[1], q.shape[1], 1)
    c, q = fit_width(c, width), fit_width(q, width)
    with np.errstate(over="ignore"):
        top = np.abs(c).max(initial=0) * np.abs(q).max(initial=0) * width
    if top < 2.0 ** 53:
        return (c @ q.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(c) @ exact(q).T, *LONG).astype(np.int64)


def _each_block(batches, shared, scale):
    """(ids, scores with the queries' own rows masked out) for each block of candidates."""
    ids_q, q = shared.value
    for ids, m in vector_blocks(batches, max(1, min(BLOCK, (2 << 20) // (len(ids_q) + 1)))):
        yield ids, _scores(_integers(m, scale), q), ids[:, None] != ids_q[None, :]


def _histogram(shared, bounds, scale, k):
    """Task function: counts of scores per (query, bin), from the task's own k-th value up."""
    def run(batches):
        lo, width, bins = (np.asarray(x) for x in bounds.value)
        n = len(lo)
        counts = None
        for _, s, other in _each_block(batches, shared, scale):
            if counts is None:
                counts = np.zeros((n, BINS + 1), dtype=np.int64)
            # Differences of longs need 64 bits without a sign.
            steps = (s.astype(np.uint64) - lo.astype(np.uint64)) // width.astype(np.uint64)
            at = np.where(s < lo, -1, np.minimum(steps, BINS).astype(np.int64))
            at = np.where(other & (at >= 0), at + np.arange(n) * (BINS + 1), -1)
            flat = at[at >= 0]
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        if counts is None:
            return
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        qi, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int32()), pa.array(b, pa.int32()),
                                          pa.array(counts[qi, b], pa.int64())], names=["qi", "bin", "n"])
    return run


def _final(shared, floor_of, scale, k):
    """Task function: each query's k best scores at or above its floor."""
    def run(batches):
        ids_q, _ = shared.value
        least = np.asarray(floor_of.value)
        qi, sc, cid = (np.zeros(0, np.int64) for _ in range(3))
        for ids, s, other in _each_block(batches, shared, scale):
            r, c = np.nonzero((s >= least) & other)
            qi, sc, cid = np.r_[qi, c], np.r_[sc, s[r, c]], np.r_[cid, ids[r]]
            keep = best_per_query(qi, sc, cid, k)
            qi, sc, cid = qi[keep], sc[keep], cid[keep]
        if len(qi):
            yield pa.RecordBatch.from_arrays(
                [pa.array(qi, pa.int32()), pa.array(ids_q[qi], pa.int64()), pa.array(cid, pa.int64()), pa.array(sc, pa.int64())],
                names=["qi", "query_id", "vec_id", "score"])
    return run


def _kth_bins(hist: DataFrame, above: np.ndarray, k: int, spark) -> dict[int, tuple[int, int, int]]:
    """qi -> (bin of the k-th value, scores above that bin, scores in it); queries with fewer than
    k scores are missing.  One row per query of the chunk comes back."""
    given = spark.createDataFrame([(i, int(a)) for i, a in enumerate(above)], "qi int, above long")
    totals = hist.groupBy("qi", "bin").agg(F.sum("n").alias("n")).join(F.broadcast(given), "qi")
    down = Window.partitionBy("qi").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    upto = totals.withColumn("upto", F.sum("n").over(down) + F.col("above"))
    hit = upto.where("upto >= %d" % k).groupBy("qi").agg(F.max_by(F.struct("bin", "upto", "n"), "bin").alias("h"))
    return {r["qi"]: (r["h"]["bin"], r["h"]["upto"] - r["h"]["n"], r["h"]["n"]) for r in hit.collect()}


def exact_top_k(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, scale: int = 1024,
                chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` rows of ``df`` with the largest integer
    inner product of floor(scale * component), a row with the query's own id excepted.

    Rows with a null id, or a vector that is null or holds null or non-finite components, take no
    part.  Scores are exact; beyond a long they saturate to its ends.  Shorter vectors count as filled up with zeros.  Equal scores rank by id; repeated rows are
    candidates one by one.  Fewer than k candidates: all of them.  Rows of ``queries`` that share an id are one query: the best of the scores that all of
    them give, each counted.  No queries or no rows: no result.
    Queries go out in chunks of ``chunk_bytes``; a chunk's results are written to the shared folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    candidates = finite_vectors(df, id_col, vec_col)
    # A repeated query row asks again; more than k copies of one can't change what is best for their id.
    asked = (finite_vectors(queries, id_col, vec_col).groupBy("id", "vec").agg(F.count(F.lit(1)).alias("n"))
             .select("id", "vec", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")))).select("id", "vec"))
    size = lambda x: F.abs(x) * float(scale) + 1.0  # noqa: E731  no less than the floor's, in doubles
    longest = candidates.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + size(x) * size(x))))).first()[0] or 0.0
    parts = []
    for ids, raw in query_chunks(asked, chunk_bytes):
        q = _integers(raw, scale)
        shared = sc.broadcast((ids, q))
        n = len(ids)
        with np.errstate(over="ignore", invalid="ignore"):
            reach = np.sqrt((q * q).sum(axis=1)) * (longest * 1.0000001) + 1
        reach = [int(x) + 1 if x < float(LONG[1]) else LONG[1] + 1 for x in reach]
        lo, hi = [max(LONG[0], -r) for r in reach], [min(LONG[1], r) for r in reach]
        above, done = np.zeros(n, np.int64), np.zeros(n, bool)
        while not done.all():
            width = [max(1, -(-(h - a + 1) // BINS)) for a, h in zip(lo, hi, strict=True)]
            bounds = sc.broadcast((np.array(lo), np.array(width), BINS))
            hist = candidates.mapInArrow(_histogram(shared, bounds, scale, k), "qi int, bin int, n long")
            # Scores above the interval land in bin BINS: already counted in ``above`` after pass one.
            hist = hist.where(F.col("bin") < BINS)
            found = _kth_bins(hist, above, k, spark)
            for i in np.nonzero(~done)[0]:
                if i not in found:  # fewer than k scores in all: every one counts
                    done[i], lo[i] = True, LONG[0]
                    continue
                b, over, inside = found[i]
                above[i] = over
                lo[i], hi[i] = lo[i] + b * width[i], lo[i] + (b + 1) * width[i] - 1
                done[i] = width[i] == 1 or over + inside <= 4 * k
        floors = sc.broadcast(np.array(lo))
        kept = candidates.mapInArrow(_final(shared, floors, scale, k), "qi int, query_id long, vec_id long, score long")
        order = Window.partitionBy("qi").orderBy(F.desc("score"), "vec_id")
        parts.append(cut(kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                             .select("query_id", "rank", "vec_id", "score")))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "rank")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

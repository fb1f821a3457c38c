"""Operator 7: approximate nearest neighbours with a hash-prefix forest.

Every vector gets one long hash string per tree (signs of random projections).  The index is a table
of shards; a shard holds, per tree, its hash strings as a sorted array.  A query descends to the
longest prefix that matches in any tree and then ascends in all trees at once, one bit at a time,
until the matches of all trees together reach the wanted number and enough different entries are among them (an entry
close by matches in every tree); those candidates are scored exactly.

Identical vectors are one entry of a shard with a list of ids, so a vector that a third of all rows
share neither fills the candidate sets nor gathers in one task: shards are cut by place, not by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import best_per_query, cut, finite_vectors, fit_width, query_chunks, vector_blocks

TREES = 96
BITS = 24
SHARD_ROWS = 4096
# Matches wanted over all trees: so many per entry of a shard, and so many in any case.  On isotropic
# 64-dimensional vectors (the hardest case: no structure to hash) this scores about half of a full
# shard for a recall above 0.9; in small tables the k-th neighbour is hardly nearer than the rest.
MATCHES = 0.40
LEAST_MATCHES = 500
# Different entries wanted, as a share of a shard's; never less than the k asked for.  Where vectors lie in groups, a group
# alone, which matches in every tree, does not end the search.
LEAST_SHARE = 0.60
SEED = 20
CHUNK_BYTES = 1 << 20

SHARD_SCHEMA = "width int, starts binary, ids binary, vectors binary, codes binary, places binary"


def _planes(width: int, trees: int, bits: int, seed: int) -> np.ndarray:
    """Random directions; row by row from one stream, so that any width agrees on its first rows.
    The last row belongs to the component that evens out the vectors' lengths."""
    return np.random.default_rng(seed).standard_normal((width + 1, trees * bits))


def _hash_strings(vectors: np.ndarray, extra: np.ndarray, planes: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """trees x rows codes of ``bits`` bits, first projection in the highest bit."""
    signs = (vectors @ planes[:-1] + extra[:, None] * planes[-1]) > 0
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.float64)
    return (signs.reshape(len(vectors), trees, bits) @ weights).astype(np.uint32).T


def _build(trees, bits, shard_rows, seed):
    def run(batches):
        for ids, m in vector_blocks(batches, shard_rows):
            entries, group = np.unique(m, axis=0, return_inverse=True)
            order = np.lexsort((ids, group))
            starts = np.searchsorted(group[order], np.arange(len(entries) + 1))
            lengths = (entries * entries).sum(axis=1)
            # Inner product, not angle: a further component makes all entries equally long.
            extra = np.sqrt(np.maximum(lengths.max(initial=0) - lengths, 0))
            codes = _hash_strings(entries, extra, _planes(m.shape[1], trees, bits, seed), trees, bits)
            places = np.argsort(codes, axis=1, kind="stable").astype(np.uint16 if shard_rows <= 1 << 16 else np.uint32)
            codes = np.take_along_axis(codes, places.astype(np.int64), axis=1)
            cells = [m.shape[1], starts.astype(np.int64).tobytes(), ids[order].tobytes(), entries.tobytes(),
                     codes.tobytes(), places.tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(cells)],
                names=[x.split()[0] for x in SHARD_SCHEMA.split(", ")])
    return run


def build_forest(df: DataFrame, id_col: str, vec_col: str, trees: int = TREES, bits: int = BITS,
                 shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """The index: one row per shard of at most ``shard_rows`` vectors, every vector that takes part
    in it.  Null ids and vectors that are null, zero, empty or hold null or non-finite components
    take no part."""
    if not 1 <= bits <= 32:
        raise ValueError("1 to 32 bits")
    vectors = finite_vectors(df, id_col, vec_col, allow_zero=False)
    return cut(vectors.mapInArrow(_build(trees, bits, shard_rows, seed), SHARD_SCHEMA))


def _candidates(codes, places, asked, bits, wanted, usable, k):
    """Boolean queries x entries: matches at the deepest level where all trees together hold ``wanted``, and where
    at least ``k`` different entries, and ``LEAST_SHARE`` of all, are ``usable`` (all of them, if fewer)."""
    trees, nq = asked.shape
    n = usable.shape[1]
    found = np.zeros((nq, n), dtype=bool)
    most = usable.sum(axis=1)
    need = np.minimum(most, np.maximum(k, np.ceil(LEAST_SHARE * most)))
    todo = np.arange(nq)
    for depth in range(bits, -1, -1):
        if not len(todo):
            break
        span = np.uint64(1 << (bits - depth))
        low = asked[:, todo].astype(np.uint64) // span * span
        begin = np.stack([np.searchsorted(codes[t], low[t]) for t in range(trees)])
        end = np.stack([np.searchsorted(codes[t], low[t] + span) for t in range(trees)])
        ready = ((end - begin).sum(axis=0) >= wanted) | (depth == 0)
        if ready.any():
            rows = todo[ready]
            for t in range(trees):
                b, e = begin[t][ready], end[t][ready]
                size = e - b
                at = np.repeat(b - (np.cumsum(size) - size), size) + np.arange(size.sum())
                found[np.repeat(rows, size), places[t][at]] = True
            # Shorter prefixes hold what longer ones held, so a query that goes on keeps its marks.
            enough = (found[rows] & usable[rows]).sum(axis=1) >= need[rows]
            todo = np.r_[todo[~ready], rows[~enough]] if depth else todo[:0]
    return found


def _search(shared, k, trees, bits, matches, seed):
    def run(batches):
        ids_q, q_all = shared.value
        qi, sc, cid = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        hashed: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                width, *cells = (batch.column(i)[row].as_py() for i in range(6))
                starts, ids, vectors, codes, places = _cells(cells)
                n = len(starts) - 1
                vectors, codes, places = vectors.reshape(n, width), codes.reshape(trees, n), places.reshape(trees, n)
                q = fit_width(q_all, width)
                if width not in hashed:
                    hashed[width] = _hash_strings(q, np.zeros(len(q)), _planes(width, trees, bits, seed), trees, bits)
                new_q, new_s, new_i = [qi], [sc], [cid]
                total, by_id = np.diff(starts), np.argsort(ids, kind="stable")
                lows, highs = (np.searchsorted(ids[by_id], ids_q, side) for side in ("left", "right"))
                # Of every entry, how many of its ids are the query's own (by query; most have none in this shard).
                owns = {i: np.bincount(np.searchsorted(starts, by_id[lows[i]:highs[i]], "right") - 1, minlength=n)
                        for i in np.flatnonzero(highs > lows)}
                none = np.zeros(n, dtype=np.int64)
                usable = np.ones((len(q), n), dtype=bool)
                for i, own in owns.items():
                    usable[i] = total > own
                found = _candidates(codes, places, hashed[width], bits, matches * n + LEAST_MATCHES, usable, k)
                for i in range(len(q)):
                    own = owns.get(i, none)
                    at = np.flatnonzero(found[i] & usable[i])
                    # Summed entry by entry in one order: equal vectors get equal scores in every shard.
                    s = np.einsum("ij,j->i", vectors[at], q[i])
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        at, s = at[s >= least], s[s >= least]
                    size = np.minimum(total[at], k + own[at])
                    pick = np.repeat(starts[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    keep = ids[pick] != ids_q[i]
                    new_i.append(ids[pick][keep])
                    new_s.append(np.repeat(s, size)[keep])
                    new_q.append(np.full(keep.sum(), i))
                qi, sc, cid = np.concatenate(new_q), np.concatenate(new_s), np.concatenate(new_i)
                keep = best_per_query(qi, sc, cid, k)
                qi, sc, cid = qi[keep], sc[keep], cid[keep]
        if len(qi):
            yield pa.RecordBatch.from_arrays(
                [pa.array(qi, pa.int32()), pa.array(ids_q[qi], pa.int64()), pa.array(cid, pa.int64()), pa.array(sc, pa.float64())],
                names=["qi", "query_id", "vec_id", "score"])
    return run


def _cells(cells):
    starts, ids, vectors, codes, places = cells
    n = len(starts) // 8 - 1
    kind = np.uint16 if len(places) * 2 == len(codes) else np.uint32
    return (np.frombuffer(starts, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64),
            np.frombuffer(codes, np.uint32), np.frombuffer(places, kind).astype(np.int64) if n else np.zeros(0, np.int64))


def search_forest(forest: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, trees: int = TREES,
                  bits: int = BITS, matches: float = MATCHES, seed: int = SEED,
                  chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` found entries with the largest inner product, ties to
    the smaller id, entries with the query's own id excepted.

    The forest's parameters must be those it was built with.  Queries without a proper vector are not
    answered; the query set goes out in chunks of ``chunk_bytes``.  A task sends at most k rows per
    query.  An empty index or query set gives no rows.
    """
    spark = forest.sparkSession
    asked = finite_vectors(queries, id_col, vec_col, allow_zero=False).distinct()
    parts = []
    for ids, q in query_chunks(asked, chunk_bytes):
        shared = spark.sparkContext.broadcast((ids, q))
        found = forest.mapInArrow(_search(shared, k, trees, bits, matches, seed),
                                  "qi int, query_id long, vec_id long, score double")
        order = Window.partitionBy("qi").orderBy(F.desc("score"), "vec_id")
        parts.append(cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                              .select("query_id", "rank", "vec_id", "score")))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

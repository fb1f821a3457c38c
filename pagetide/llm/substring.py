"""Operator 9: substring dedup by minimizer selection and span extension, in place of level-wise doubling.

A window of ``length`` words can only be repeated if every shorter window inside it is.  So the levels
climb from short windows to long ones, and only what is repeated at one level is extended to about
twice its length at the next:

1. quarter windows.  Of those inside a full window only the one with the smallest hash is looked at:
   equal full windows choose the same one, and one word in fourteen remains to be counted.
2. a repeated quarter window is extended on both sides to the span of all full windows that chose it
   (up to twice the full length).  If that whole span is repeated, so is every window in it.
3. where a span is alone, its full windows are compared one by one with the other spans' windows.

Counting is pre-aggregated at every level, so a passage that a third of all documents share costs
each task one row.  What is counted is stored before it is joined back, so that the join of a hot
window can be split.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, prefix_sums, range_hashes, stored, text_bytes, word_hashes

LENGTH = 35
_BASE2 = 0xC2B2AE3D27D4EB4F
_UNBASE2 = pow(_BASE2, -1, 1 << 64)


def _second(words: np.ndarray) -> np.ndarray:
    return mix64(words + np.uint64(0x165667B19E3779F9))


def chosen_spans(words: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(quarter hash, span hash, first window, windows) of every run of full windows that choose the
    same quarter window; empty for a text with fewer than ``length`` words."""
    n = len(words) - length + 1
    if n < 1:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    quarter = max(1, length // 4)
    reach = length - quarter + 1
    sums = prefix_sums(words)
    at = np.arange(len(words) - quarter + 1)
    short = mix64(range_hashes(sums, at, at + quarter))
    chosen = np.empty(n, dtype=np.int64)
    step = 1 << 16
    for i in range(0, n, step):
        view = np.lib.stride_tricks.sliding_window_view(short[i:i + step + reach - 1], reach)
        j = view[:n - i].argmin(axis=1)  # the leftmost of equal ones
        chosen[i:i + len(j)] = j + np.arange(i, i + len(j))
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    count = np.diff(np.r_[first, n])
    offset = (chosen[first] - first).astype(np.uint64)
    span = range_hashes(sums, first, first + count + length - 1)
    span = mix64(span + offset * np.uint64(1 << 20) + count.astype(np.uint64))
    return short[chosen[first]], span, first, count


def full_windows(words: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows that start at ``begin``."""
    one = range_hashes(prefix_sums(words), begin, begin + length)
    two = range_hashes(prefix_sums(_second(words), _BASE2), begin, begin + length, _UNBASE2)
    return mix64(one), mix64(two)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _spans(length):
    def run(batches):
        for batch in batches:
            found = [chosen_spans(word_hashes(t or b""), length) for t in text_bytes(batch.column("text"))]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            quarter, span, first, count = (np.concatenate([f[i] for f in found]) for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), batch.column("key").take(rows), _signed(quarter), _signed(span),
                 pa.array(first, pa.int32()), pa.array(count, pa.int32())],
                names=["id", "key", "quarter", "span", "first", "count"])
    return run


def _windows(length):
    def run(batches):
        for batch in batches:
            ids, keys, ones, twos, starts, alone = [], [], [], [], [], []
            spans = batch.column("spans").to_pylist()
            for i, text in enumerate(text_bytes(batch.column("text"))):
                words = word_hashes(text)
                begin = np.concatenate([np.arange(s["first"], s["first"] + s["count"]) for s in spans[i]])
                one, two = full_windows(words, begin, length)
                ones.append(one)
                twos.append(two)
                starts.append(begin)
                alone.append(np.repeat([s["alone"] for s in spans[i]], [s["count"] for s in spans[i]]))
                ids.append(np.full(len(begin), i))
            if ids:
                rows = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("key").take(rows), _signed(np.concatenate(ones)),
                     _signed(np.concatenate(twos)), pa.array(np.concatenate(starts), pa.int32()),
                     pa.array(np.concatenate(alone).astype(bool))],
                    names=["id", "key", "one", "two", "first", "alone"])
    return run


def _cut_texts(length, keep_untouched):
    def run(batches):
        for batch in batches:
            total, removed, kept = [], [], []
            marks = batch.column("marks").to_pylist()
            for text, mark in zip(text_bytes(batch.column("text")), marks, strict=True):
                words = (text or b"").split()
                total.append(len(words))
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                for m in mark or ():
                    cover[m["first"]] += 1
                    cover[m["first"] + m["count"] + length - 1] -= 1
                keep = np.cumsum(cover[:-1]) == 0
                removed.append(int((~keep).sum()))
                kept.append(text if keep_untouched and keep.all() else b" ".join(compress(words, keep.tolist())))
            rest = [n for n in batch.schema.names if n not in ("text", "marks")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in rest], pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k or b"").hexdigest() for k in kept])],
                names=[*rest, "n_words", "n_removed", "kept", "sha256"])
    return run


def without_repeats(docs: DataFrame, doc_id: str, text: str, length: int = LENGTH,
                    carry: dict[str, Column] | None = None, keep_untouched: bool = False) -> DataFrame:
    """(id, the ``carry`` columns, n_words, n_removed, kept binary, sha256), one row per row of ``docs``.

    Every word covered by a window of ``length`` words whose word sequence also starts anywhere else,
    the same document included, is left out of ``kept`` (UTF-8, joined by one space).  Windows are
    judged on the input.  With ``keep_untouched``, a text that loses no word stays as it is, null included.
    A repeated row is a further document: its windows are repeated.  A null text
    has no words; so has an empty one.  An empty table gives an empty result.
    """
    carry = carry or {}
    # A document is named by its id and a hash of its text: rows that agree in both agree in what is removed.
    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).cast("binary").alias("text"),
                         *[c.alias(f"c_{n}") for n, c in carry.items()])
    id_type = source.schema["id"].dataType.simpleString()
    same = ["id", "key"]

    def on_same(left, right):
        return left["id"].eqNullSafe(right["r_id"]) & (left["key"] == right["r_key"])

    # Level 1.
    spans = source.select("id", "key", "text").mapInArrow(
        _spans(length), f"id {id_type}, key long, quarter long, span long, first int, count int")
    quarters = stored(spans.groupBy("quarter").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("quarter"), "quarters")
    spans = stored(spans.join(quarters, "quarter", "left_semi"), "spans")
    # Level 2.
    groups = stored(spans.groupBy("quarter", "span").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "first", "count")).alias("one")), "groups")
    repeated = spans.join(groups.where("n > 1").select("quarter", "span"), ["quarter", "span"], "left_semi")
    mixed = stored(groups.where("n = 1").select("quarter").distinct(), "mixed")
    members = groups.join(mixed, "quarter", "left_semi").select("one.*", (F.col("n") == 1).alias("alone"))
    # Level 3.
    wanted = members.groupBy(same).agg(F.collect_list(F.struct("first", "count", "alone")).alias("spans")).select(
        F.col("id").alias("r_id"), F.col("key").alias("r_key"), "spans")
    windows = source.join(wanted, on_same(source, wanted)).select("id", "key", "text", "spans").mapInArrow(
        _windows(length), f"id {id_type}, key long, one long, two long, first int, alone boolean")
    often = stored(windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two"), "windows")
    hits = windows.where("alone").join(often, ["one", "two"], "left_semi").select(*same, "first", F.lit(1).alias("count"))
    marks = (repeated.select(*same, "first", "count").unionByName(hits)
                     .groupBy(same).agg(F.collect_set(F.struct("first", "count")).alias("marks"))
                     .select(F.col("id").alias("r_id"), F.col("key").alias("r_key"), "marks"))
    joined = source.join(marks, on_same(source, marks), "left").drop("r_id", "r_key", "key")
    rest = [f for f in joined.schema.fields if f.name not in ("text", "marks")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    out = joined.mapInArrow(_cut_texts(length, keep_untouched), f"{schema}, n_words long, n_removed long, kept binary, sha256 string")
    return out.select("id", *[F.col(f"`c_{n}`").alias(n) for n in carry], "n_words", "n_removed", "kept", "sha256")

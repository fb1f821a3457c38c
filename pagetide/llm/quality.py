"""Operator 1: quality classifier by ordinal cumulative-link regression.

Graded ratings y in 0 ... K-1 are modelled as P(y <= j) = logistic(t_j - w . x): one weight vector
over hashed text features shared by all grades, and K-1 ordered thresholds.  The fit is maximum
likelihood by L-BFGS; every gradient is one Spark job over the feature table, from which each task
returns one partial sum.  Documents are scored with the expected grade and the tail probability that
selection uses.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_bytes, word_hashes

BITS = 17
DIMS = 1 << BITS
# Bound of the training sample: so many ratings, those with the smallest draw.
MAX_RATINGS = 20_000
PARTS = 6
ROUNDS = 40
PENALTY = 1e-4
STATISTICS_PENALTY = 1e-5

_KIND = np.zeros(256, dtype=np.int8)  # 0 letters and beyond ASCII, 1 upper case, 2 digits, 3 other signs, 4 blanks
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = 1
_KIND[97:123] = 0
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_WORDS_ONLY = bytes(32 if _KIND[i] in (3, 4) else i for i in range(256))
STATISTICS = 11
PRESENT = 0.5


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values): which hashed lower-case words the text holds (one telling word counts as much
    in a long text as in a short one), and statistics of the text in the last places: kinds of
    characters, lengths, repetition.  A null text is an empty one."""
    data = text or b""
    words = word_hashes(data.lower().translate(_WORDS_ONLY))
    at, count = np.unique(words >> np.uint64(64 - BITS), return_counts=True)
    kinds = np.zeros(5)
    for i in range(0, len(data), 1 << 20):
        kinds += np.bincount(_KIND[np.frombuffer(data, np.uint8, min(1 << 20, len(data) - i), i)], minlength=5)
    kinds /= max(1, len(data))
    n = max(1, len(words))
    statistics = [1.0, *kinds[1:], len(at) / min(n, DIMS), min(1.0, np.log1p(len(words)) / 10), min(1.0, len(data) / (20 * n)),
                  np.count_nonzero(words[1:] == words[:-1]) / n, count.max(initial=0) / n, min(1.0, 4 * data.count(b"\n") / n)]
    return np.r_[at.astype(np.int64), DIMS + np.arange(STATISTICS)], np.r_[np.full(len(at), PRESENT), statistics]


def _feature_rows(batches):
    for batch in batches:
        found = [features(t) for t in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("grade"), pa.array([f[0] for f in found], pa.list_(pa.int32())),
             pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["grade", "idx", "val"])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _thresholds(tail: np.ndarray) -> np.ndarray:
    """The first threshold is free, each further one lies an exponential above: always ordered."""
    return np.r_[tail[0], tail[0] + np.cumsum(np.exp(tail[1:]))]


def _partial(shared, grades):
    """Task function: (log likelihood, gradient) of the task's rows."""
    def run(batches):
        params = shared.value
        width = DIMS + STATISTICS
        w, tail = params[:width], params[width:]
        t = np.r_[-np.inf, _thresholds(tail), np.inf]
        total, rows, grad, by_cut = 0.0, 0, np.zeros(width), np.zeros(grades - 1)
        for batch in batches:
            y = batch.column("grade").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(y):
                continue
            idx, val = batch.column("idx").flatten().to_numpy(), batch.column("val").flatten().to_numpy()
            size = np.diff(batch.column("idx").offsets.to_numpy())
            row = np.repeat(np.arange(len(y)), size)
            f = np.bincount(row, weights=w[idx] * val, minlength=len(y))
            up, low = _sigmoid(t[y + 1] - f), _sigmoid(t[y] - f)
            p = np.maximum(up - low, 1e-12)
            d_up, d_low = up * (1 - up) / p, -low * (1 - low) / p
            total += float(np.log(p).sum())
            rows += len(y)
            grad += np.bincount(idx, weights=-(d_up + d_low)[row] * val, minlength=width)
            by_cut += np.bincount(y, weights=d_up, minlength=grades)[:grades - 1] + np.bincount(y, weights=d_low, minlength=grades)[1:]
        if rows:
            slopes = [by_cut.sum(), *(np.exp(tail[j]) * by_cut[j:].sum() for j in range(1, grades - 1))]
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([rows], pa.int64()),
                                              pa.array([np.r_[grad, slopes].tobytes()], pa.binary())], names=["loss", "n", "grad"])
    return run


def _minimise(objective, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving."""
    value, grad = objective(x)
    past: deque = deque(maxlen=memory)
    for _ in range(rounds):
        direction, steps = grad.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ direction)
            steps.append(a)
            direction -= a * y
        if past:
            s, y, _ = past[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(steps), strict=True):
            direction += (a - r * (y @ direction)) * s
        slope, step = grad @ direction, 1.0 if past else 1.0 / max(1.0, np.abs(grad).sum())
        for _ in range(12):
            new = x - step * direction
            new_value, new_grad = objective(new)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            past.append((s, y, 1 / (s @ y)))
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]  # the rating of each grade, ascending

    def tails(self, text: bytes | None) -> np.ndarray:
        """P(y >= j) for j = 1 ... K-1."""
        idx, val = features(text)
        return _sigmoid(float(self.weights[idx] @ val) - self.thresholds)


def train(docs: DataFrame, doc_id: str, text: str, ratings: DataFrame, rated_id: str, rating: Column,
          max_ratings: int = MAX_RATINGS) -> Model | None:
    """Fit on the texts of the ``max_ratings`` rated documents with the smallest draw (a hash of the id).

    Ratings without an id, a grade or a document are left out; a null text counts as empty, repeated
    ratings count each.  None if fewer than two grades occur.
    """
    rated = ratings.select(F.col(rated_id).alias("id"), rating.cast("int").alias("rating")).where("id IS NOT NULL AND rating IS NOT NULL")
    sample = cut(rated.orderBy(F.xxhash64(F.lit("rated"), "id"), "id", "rating").limit(max_ratings))
    grades = sorted(r[0] for r in sample.select("rating").distinct().collect())
    if len(grades) < 2:
        return None
    place = F.array_position(F.array(*[F.lit(g) for g in grades]), F.col("rating")).cast("int") - 1
    # At most max_ratings rows of two numbers: small enough to broadcast by its bound.
    wanted = F.broadcast(sample.select("id", place.alias("grade")))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text")).join(wanted, "id")
    table = cut(texts.select("grade", "text").mapInArrow(_feature_rows, "grade int, idx array<int>, val array<double>").repartition(PARTS))
    if table.select("grade").distinct().count() < 2:
        return None
    sc = docs.sparkSession.sparkContext
    width = DIMS + STATISTICS
    penal = np.r_[np.full(DIMS, PENALTY), np.full(STATISTICS, STATISTICS_PENALTY), np.zeros(len(grades) - 1)]

    def objective(x):
        shared = sc.broadcast(x)
        parts = table.mapInArrow(_partial(shared, len(grades)), "loss double, n long, grad binary").collect()
        shared.destroy()
        n = sum(p["n"] for p in parts)
        loss = -sum(sorted(p["loss"] for p in parts)) / n
        grad = -sum(np.frombuffer(p["grad"]) for p in parts) / n
        return loss + 0.5 * float(penal @ (x * x)), grad + penal * x

    found = _minimise(objective, np.zeros(width + len(grades) - 1), ROUNDS)
    return Model(found[:width], _thresholds(found[width:]), grades)


def _score_rows(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            expected, tail = [], []
            for text in text_bytes(batch.column("__text")):
                if model is None:
                    expected.append(None)
                    tail.append(None)
                    continue
                above = model.tails(text)
                steps = np.diff(model.grades)
                expected.append(round(model.grades[0] + float(steps @ above), 6))
                tail.append(round(float(above[-1]), 6))
            rest = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(expected, pa.float64()), pa.array(tail, pa.float64())],
                                             names=[*rest, "expected_grade", "tail_probability"])
    return run


def score(docs: DataFrame, text: str, model: Model | None, keep: dict[str, Column], least_tail: float = 0.6) -> DataFrame:
    """The ``keep`` columns, expected_grade, tail_probability (of the best grade) and selected (the tail
    reaches ``least_tail``) of every row.  Whole texts, one pass, no shuffle.  Without a model both
    scores are null and every row is selected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).cast("binary").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    scored = rows.mapInArrow(_score_rows(shared), ", ".join(x for x in (schema, "expected_grade double, tail_probability double") if x))
    return scored.withColumn("selected", F.coalesce(F.col("tail_probability") >= least_tail, F.lit(True)))

"""Exact order statistics, interval edges and interval (range) joins.

Order statistics are taken from a value histogram per feature instead of a
global sort: ``groupBy(feature, value).count()`` (partial aggregation, skew
safe), then cumulative counts over range partitions of (feature, value), so a feature with many
distinct values is spread over many tasks.  Work after the first
aggregation is proportional to the number of distinct values, not rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.operators.ordering import running_total


def unpivot(df: DataFrame, features: list[str], keep: list[str] | None = None,
            name: str = "feature", value: str = "value") -> DataFrame:
    """Wide feature columns -> (keep..., feature, value) rows, one scan."""
    keep = keep or []
    cells = F.array(*[F.struct(F.lit(f).alias(name), F.col(f).alias(value)) for f in features])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, f"_c.{name}", f"_c.{value}")


def histogram(long: DataFrame, feature: str = "feature", value: str = "value", descending: bool = False) -> DataFrame:
    """(feature, value, cnt, lo, hi, n): each distinct value covers sorted
    positions lo..hi (0-based) among the n non-null values of its feature."""
    h = long.filter(F.col(value).isNotNull()).groupBy(feature, value).agg(F.count(F.lit(1)).alias("cnt"))
    ordered = running_total(h, [F.col(feature), F.col(value).desc() if descending else F.col(value)], "cnt", name="_end")
    # A row per feature: names of columns, not data.
    ranges = ordered.groupBy(feature).agg(F.min(F.col("_end") - F.col("cnt")).alias("_base"), F.sum("cnt").alias("n")).select(
        F.col(feature).alias("_f"), "_base", "n")
    placed = ordered.join(F.broadcast(ranges), F.col(feature).eqNullSafe(F.col("_f")))
    hi = F.col("_end") - F.col("_base") - 1
    return placed.select(feature, value, "cnt", (hi - F.col("cnt") + 1).alias("lo"), hi.alias("hi"), "n")


RANK_BLOCK = 10_000


def rank_curve(ranges: DataFrame, keep: list[str], value: str) -> DataFrame:
    """(``keep``, position, percentile, value), one row per counted value, from ``histogram(..., descending=True)``.

    A value's positions lo..hi are written out from the histogram, in blocks of at most ``RANK_BLOCK``, so neither the
    values nor their owners are ever ranked one by one.  The axis runs evenly from 0 to 100.
    """
    starts = ranges.select(*keep, value, "hi", "n", F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(RANK_BLOCK).cast("bigint"))).alias("_from"))
    rows = starts.select(*keep, value, "n", F.explode(F.sequence("_from", F.least(F.col("hi"), F.col("_from") + (RANK_BLOCK - 1)))).alias("_at"))
    percentile = F.when(F.col("n") > 1, F.col("_at") * 100.0 / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return rows.select(*keep, (F.col("_at") + 1).alias("position"), percentile.alias("percentile"), value)


def _value_at(pos: Column, value: str = "value") -> Column:
    """Aggregate: the value whose position range holds ``pos``."""
    return F.min(F.when((F.col("lo") <= pos) & (pos <= F.col("hi")), F.col(value)))


def percentiles(long: DataFrame, ps=(0, 20, 40, 60, 80, 100), feature: str = "feature",
                value: str = "value") -> DataFrame:
    """(feature, percentile, value) with the order statistic at floor((n-1)*p/100)."""
    h = histogram(long, feature, value)
    picks = [_value_at(F.floor((F.col("n") - 1) * p / 100), value).alias(f"p{p}") for p in ps]
    wide = h.groupBy(feature).agg(*picks)
    cells = F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"p{p}").alias("value")) for p in ps])
    return wide.select(feature, F.explode(cells).alias("_c")).select(feature, "_c.percentile", "_c.value")


def value_statistics(long: DataFrame, ignore_extremes: float = 0.0, feature: str = "feature",
                     value: str = "value") -> DataFrame:
    """(feature, min, max, avg, med) with two-sided trimming of int(n*e) values.

    The trimmed mean divides by the number of values kept; the median of an
    even count averages positions n/2-1 and n/2 and truncates to an integer.
    """
    h = histogram(long, feature, value)
    t = F.floor(F.col("n") * F.lit(float(ignore_extremes)))
    first, last = t, F.col("n") - 1 - t
    overlap = F.greatest(F.lit(0), F.least(F.col("hi"), last) - F.greatest(F.col("lo"), first) + 1)
    half = F.floor(F.col("n") / 2)
    even = F.col("n") % 2 == 0
    agg = h.groupBy(feature).agg(
        _value_at(first, value).alias("min"),
        _value_at(last, value).alias("max"),
        F.try_divide(F.sum(F.col(value) * overlap).cast("double"), F.sum(overlap).cast("double")).alias("avg"),
        _value_at(F.when(even, half - 1).otherwise(half), value).alias("_m1"),
        _value_at(half, value).alias("_m2"),
        F.max(F.col("n")).alias("_n"))
    med = F.when(F.col("_n") % 2 == 0, ((F.col("_m1") + F.col("_m2")) / 2).cast("bigint")).otherwise(
        F.col("_m2").cast("bigint"))
    return agg.select(feature, "min", "max", "avg", med.alias("med"))


def interval_edges(long: DataFrame, k: int = 10, feature: str = "feature", value: str = "value") -> DataFrame:
    """(feature, interval, start, end): k equal-frequency intervals; edge i is the
    value at position int((n-1)/k*i); the last edge is raised by one so the
    maximum falls inside the half-open last interval."""
    h = histogram(long, feature, value)
    step = (F.col("n") - 1) / F.lit(float(k))
    edges = [_value_at(F.floor(step * i), value).alias(f"e{i}") for i in range(k + 1)]
    wide = h.groupBy(feature).agg(*edges)
    cells = F.array(*[
        F.struct(F.lit(i).alias("interval"), F.col(f"e{i}").alias("start"),
                 (F.col(f"e{i + 1}") + (1 if i + 1 == k else 0)).alias("end"))
        for i in range(k)])
    return wide.select(feature, F.explode(cells).alias("_c")).select(feature, "_c.interval", "_c.start", "_c.end")


def _interval_table(intervals: DataFrame, feature: str = "feature") -> dict[str, Column]:
    """Every feature's intervals as one literal array; as many in all as features x intervals were asked for."""
    found: dict[str, list[tuple]] = {}
    for r in intervals.select(feature, "interval", "start", "end").collect():
        found.setdefault(r[0], []).append((r["interval"], r["start"], r["end"]))
    kinds = ", ".join(f"`{c}`: {intervals.schema[c].dataType.simpleString()}" for c in ("interval", "start", "end"))
    # From text, which is folded to a literal: an array of structs built up by expressions would not fit generated code.
    return {f: F.from_json(F.lit(json.dumps([dict(zip(("interval", "start", "end"), x, strict=True)) for x in sorted(rows)])),
                           f"array<struct<{kinds}>>") for f, rows in found.items()}


def _intervals_of(value: Column, table: Column) -> Column:
    """The intervals of ``table`` that hold ``value``: start <= value < max(start + 1, end)."""
    return F.filter(table, lambda x: (x["start"] <= value) & (value < F.greatest(x["start"] + 1, x["end"])))


def interval_join(long: DataFrame, intervals: DataFrame, feature: str = "feature",
                  value: str = "value") -> DataFrame:
    """Rows matched to every interval with start <= value < max(start + 1, end).

    Zero-width intervals are widened to one, so a value may land in several.
    The interval table has features x intervals rows (bounded by its
    definition, not by the data): it is read once and becomes an expression, so that
    the rows are neither joined nor moved.
    """
    hits = F.lit(None)
    for name, table in _interval_table(intervals, feature).items():
        hits = F.when(F.col(feature) == name, _intervals_of(F.col(value), table)).otherwise(hits)
    return long.select("*", F.explode(hits).alias("_i")).select(*long.columns, "_i.interval", "_i.start")


def error_heatmap(predictions: DataFrame, features: list[str], intervals: DataFrame,
                  label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(feature, interval, accuracy): share of correct predictions among rows whose
    feature value lies in the interval; rounded to 4 places, null when empty.  One scan of the predictions: every row
    looks its intervals up in the (small) table of edges."""
    table = _interval_table(intervals)
    correct = (F.col(label) == F.col(prediction)).cast("int")
    def cells(f):
        return F.transform(_intervals_of(F.col(f), table[f]), lambda x: F.struct(F.lit(f).alias("feature"), x["interval"].alias("interval")))

    empty = F.array().cast("array<struct<feature:string,interval:int>>")
    hits = predictions.select(correct.alias("_ok"), F.explode(F.concat(empty, *[cells(f) for f in features if f in table])).alias("_c")).groupBy("_c.feature", "_c.interval").agg(
        F.sum("_ok").alias("_c"), F.count(F.lit(1)).alias("_t"))
    grid = intervals.select("feature", "interval")
    return (grid.join(hits, ["feature", "interval"], "left")
                .select("feature", "interval",
                        F.round(F.try_divide(F.col("_c").cast("double"), F.col("_t").cast("double")), 4)
                        .alias("accuracy")))


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: tn, fp, fn, tp, recall_zero, recall_one, min_recall."""
    lab, pred = F.col(label).cast("int"), F.col(prediction).cast("int")

    def cnt(a, b):
        return F.sum(F.when((lab == a) & (pred == b), 1).otherwise(0)).cast("bigint")

    m = predictions.agg(cnt(0, 0).alias("tn"), cnt(0, 1).alias("fp"), cnt(1, 0).alias("fn"), cnt(1, 1).alias("tp"))
    r0 = F.try_divide(F.col("tn").cast("double"), (F.col("tn") + F.col("fp")).cast("double"))
    r1 = F.try_divide(F.col("tp").cast("double"), (F.col("fn") + F.col("tp")).cast("double"))
    return m.select("tn", "fp", "fn", "tp", r0.alias("recall_zero"), r1.alias("recall_one"),
                    F.least(r0, r1).alias("min_recall"))


def accuracy(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: share of rows with label == prediction."""
    return predictions.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
                           F.count(F.lit(1)).alias("rows"))


def linspace_int(lo: Column, hi: Column, num: int) -> Column:
    """Distinct ascending integers of an even axis from lo to hi (truncated)."""
    step = (hi - lo).cast("double") / F.lit(float(max(num - 1, 1)))
    pts = F.transform(F.sequence(F.lit(0), F.lit(num - 1)),
                      lambda i: F.when(i == num - 1, hi.cast("double")).otherwise(i * step + lo).cast("bigint"))
    return F.array_sort(F.array_distinct(pts))


def feature_grid(stats: DataFrame, x_lo: str, x_hi: str, y_lo: str, y_hi: str, resolution: int = 100) -> DataFrame:
    """(x, y): every combination of two integer axes built from a one-row
    statistics table, by two generators (no join)."""
    axes = stats.select(linspace_int(F.col(x_lo), F.col(x_hi), resolution).alias("_xs"),
                        linspace_int(F.col(y_lo), F.col(y_hi), resolution).alias("_ys"))
    return (axes.select(F.explode("_xs").alias("x"), "_ys")
                .select("x", F.explode("_ys").alias("y")))

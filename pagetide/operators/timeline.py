"""Temporal change statistics over daily change bits.

Input: ``change_bits(page_id, day2, text_changed, ilinks_changed,
elinks_changed)``, one row per page and crawl-day pair (day2 = later day).

Plan shape: the only wide step over the input is one ``groupBy(page_id)`` that
builds, per page, fixed-width weekly count arrays with map-side partial sums.
Everything after it (matrix, cube, persistence, moves, edges) aggregates small
per-(feature, week, class) tables; dense 0..7 grids are generated from ranges,
never from a cross join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import dates as D
from pagetide.operators.stats import histogram, rank_curve

# Fixed: change-bit columns per feature, in the reference's display order.
FEATURE_BITS = {"text": "text_changed", "internal_outlinks": "ilinks_changed",
                "external_outlinks": "elinks_changed"}
MAX_PER_WEEK = 7


def first_stage(bits: DataFrame) -> DataFrame:
    """Pages of the first seed stage only (page id starts with ``s00-``)."""
    return bits.filter(F.substring_index(F.col("page_id"), "-", 1) == "s00")


def study_weeks(bits: DataFrame, complete_only: bool = True) -> tuple[dt.date, int]:
    """(first Monday, number of weeks) of the study (one scalar aggregate).

    With ``complete_only`` only weeks whose seven days all lie in the day2
    span count: from the first Monday on or after the first day to the last
    Sunday on or before the last day.  Weeks are then numbered 0..n-1
    (``week_no``), so a study may cross New Year or last longer than a year.
    """
    row = bits.agg(F.min("day2").alias("lo"), F.max("day2").alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return dt.date(1970, 1, 5), 0
    if complete_only:
        start = lo + dt.timedelta(days=(7 - lo.weekday()) % 7)
        end = hi - dt.timedelta(days=(hi.weekday() + 1) % 7)
    else:
        start = lo - dt.timedelta(days=lo.weekday())
        end = hi + dt.timedelta(days=6 - hi.weekday())
    return start, max(0, ((end - start).days + 1) // 7)


def week_bounds(bits: DataFrame, complete_only: bool = True) -> tuple[int, int]:
    """ISO numbers of the first and last study week (a 2021-06-13 ... 2021-09-09
    span gives weeks 24 ... 35)."""
    start, n = study_weeks(bits, complete_only)
    return start.isocalendar()[1], (start + dt.timedelta(weeks=max(n - 1, 0))).isocalendar()[1]


def _week_label(start: dt.date, week_no) -> F.Column:
    """ISO week number of study week ``week_no``."""
    return D.iso_week(F.date_add(F.lit(start), week_no * 7))


def long_bits(bits: DataFrame, keep=("page_id", "day2")) -> DataFrame:
    """Unpivot to (feature, ..., bit) without a second scan."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).cast("int").alias("bit"))
                      for f, c in FEATURE_BITS.items()])
    return bits.select(*keep, F.explode(cells).alias("_c")).select("_c.feature", *keep, "_c.bit")


def weekly_count_arrays(bits: DataFrame, start: dt.date, n_weeks: int) -> DataFrame:
    """(feature, page_id, counts) where counts[i] = changes in study week i
    (the week starting ``start`` + 7i days).

    Pages without rows in a week count 0 there.  One shuffle by page_id with
    partial aggregation before it.
    """
    pre = bits.select("page_id", F.floor(D.day_number("day2", F.lit(start)) / 7).cast("int").alias("_w"),
                      *FEATURE_BITS.values())
    sums = [F.sum(F.when(F.col("_w") == i, F.col(c)).otherwise(0)).alias(f"{f}__{i}")
            for f, c in FEATURE_BITS.items() for i in range(n_weeks)]
    wide = pre.groupBy("page_id").agg(*sums)
    per_feature = F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 F.array(*[F.col(f"{f}__{i}").cast("int") for i in range(n_weeks)]).cast("array<int>")
                  .alias("counts"))
        for f in FEATURE_BITS])
    return wide.select("page_id", F.explode(per_feature).alias("_r")).select("_r.feature", "page_id", "_r.counts")


def weekly_changes(bits: DataFrame, start: dt.date, n_weeks: int) -> DataFrame:
    """(feature, page_id, week_no, week, n): changes per page and study week
    (ISO number as ``week``), zeros included."""
    arrays = weekly_count_arrays(bits, start, n_weeks)
    return (arrays.select("feature", "page_id", F.posexplode("counts").alias("week_no", "n"))
                  .select("feature", "page_id", "week_no", _week_label(start, F.col("week_no")).alias("week"), "n"))


def _grid(spark, start: dt.date, first_no: int, n_weeks: int, n_values: int, second: bool = False) -> DataFrame:
    """Dense (feature, week_no, week, n[, cur_n]) grid from ranges (tiny, generated)."""
    g = spark.range(first_no, n_weeks).select(F.col("id").cast("int").alias("week_no"))
    g = g.select(F.explode(F.array(*[F.lit(f) for f in FEATURE_BITS])).alias("feature"), "week_no")
    g = g.select("feature", "week_no", F.explode(F.sequence(F.lit(0), F.lit(n_values - 1))).alias("n"))
    if second:
        g = g.select("feature", "week_no", F.col("n").alias("prev_n"),
                     F.explode(F.sequence(F.lit(0), F.lit(n_values - 1))).alias("cur_n"))
    return g


def change_matrix(bits: DataFrame, start: dt.date, n_weeks: int) -> DataFrame:
    """(feature, week_no, week, n, pages): number of pages with n change-days in the week."""
    counts = (weekly_changes(bits, start, n_weeks)
              .groupBy("feature", "week_no", "n").agg(F.count(F.lit(1)).alias("pages")))
    grid = _grid(bits.sparkSession, start, 0, n_weeks, MAX_PER_WEEK + 1)
    return (grid.join(counts, ["feature", "week_no", "n"], "full")
                .select("feature", "week_no", _week_label(start, F.col("week_no")).alias("week"), "n",
                        F.coalesce("pages", F.lit(0)).alias("pages")))


def change_cube(bits: DataFrame, start: dt.date, n_weeks: int) -> DataFrame:
    """(feature, week_no, week, prev_n, cur_n, pages): week-to-week transitions;
    week_no / week belong to the later week."""
    arrays = weekly_count_arrays(bits, start, n_weeks)
    if n_weeks >= 2:
        pairs = F.transform(F.sequence(F.lit(1), F.lit(n_weeks - 1)),
                            lambda i: F.struct(i.alias("week_no"), F.col("counts")[i - 1].alias("prev_n"),
                                               F.col("counts")[i].alias("cur_n")))
    else:
        pairs = F.array().cast("array<struct<week_no:int,prev_n:int,cur_n:int>>")
    counts = (arrays.select("feature", F.explode(pairs).alias("_p"))
                    .groupBy("feature", "_p.week_no", "_p.prev_n", "_p.cur_n").agg(F.count(F.lit(1)).alias("pages")))
    grid = _grid(bits.sparkSession, start, 1, n_weeks, MAX_PER_WEEK + 1, second=True)
    return (grid.join(counts, ["feature", "week_no", "prev_n", "cur_n"], "full")
                .select("feature", "week_no", _week_label(start, F.col("week_no")).alias("week"), "prev_n", "cur_n",
                        F.coalesce("pages", F.lit(0)).alias("pages")))


def alluvial_edges(cube: DataFrame) -> DataFrame:
    """Sankey edge list: source = stage*8 + prev, target = (stage+1)*8 + cur,
    where stage is the earlier study week."""
    stage = F.col("week_no") - 1
    return cube.select("feature", (stage * 8 + F.col("prev_n")).alias("source"),
                       ((stage + 1) * 8 + F.col("cur_n")).alias("target"), F.col("pages").alias("value"))


def normalized_matrix(matrix: DataFrame) -> DataFrame:
    """Matrix cells divided by the number of pages (each week's row sum)."""
    n_pages = F.sum("pages").over(Window.partitionBy("feature", "week_no"))
    return matrix.withColumn("fraction", F.try_divide(F.col("pages").cast("double"), n_pages))


def normalized_cube(cube: DataFrame) -> DataFrame:
    """Cube cells divided by the number of pages (sum of each week's cells)."""
    n_pages = F.sum("pages").over(Window.partitionBy("feature", "week_no"))
    return cube.withColumn("fraction", F.try_divide(F.col("pages").cast("double"), n_pages))


def percentile_curve(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, position, percentile, value): values sorted descending per group
    against an even 0..100 axis, from the histogram of the values."""
    return rank_curve(histogram(df, group, value, descending=True), [group], value)


def average_behaviour(matrix: DataFrame) -> DataFrame:
    """(feature, n, fraction): mean over weeks of the share of pages with n change-days."""
    per_n = matrix.groupBy("feature", "n").agg(F.sum("pages").alias("_s"))
    total = F.sum("_s").over(Window.partitionBy("feature"))  # = weeks * pages; <= 3 x 8 rows
    return per_n.select("feature", "n", F.try_divide(F.col("_s").cast("double"), total).alias("fraction"))


def _class3(c) -> F.Column:
    """Three behaviour classes: 0 never, 1 sometimes (1-6), 2 always (7)."""
    return F.when(c == 0, 0).when(c == MAX_PER_WEEK, 2).otherwise(1)


def _ratio(num, den) -> F.Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def persistence(cube: DataFrame) -> DataFrame:
    """(feature, week, prev_n, fraction): share of pages keeping the same weekly count."""
    return (cube.groupBy("feature", "week_no", "week", "prev_n")
                .agg(_ratio(F.sum(F.when(F.col("prev_n") == F.col("cur_n"), F.col("pages")).otherwise(0)),
                            F.sum("pages")).alias("fraction")))


def persistence3(cube: DataFrame) -> DataFrame:
    """(feature, week, prev_class, fraction) with classes never / sometimes / always."""
    same = _class3(F.col("prev_n")) == _class3(F.col("cur_n"))
    return (cube.groupBy("feature", "week_no", "week", _class3(F.col("prev_n")).alias("prev_class"))
                .agg(_ratio(F.sum(F.when(same, F.col("pages")).otherwise(0)), F.sum("pages")).alias("fraction")))


def persistence_all(cube: DataFrame) -> DataFrame:
    """(feature, week, same8, same3): persistence over all classes combined."""
    same8 = F.col("prev_n") == F.col("cur_n")
    same3 = _class3(F.col("prev_n")) == _class3(F.col("cur_n"))
    return (cube.groupBy("feature", "week_no", "week")
                .agg(_ratio(F.sum(F.when(same8, F.col("pages")).otherwise(0)), F.sum("pages")).alias("same8"),
                     _ratio(F.sum(F.when(same3, F.col("pages")).otherwise(0)), F.sum("pages")).alias("same3")))


def neighbour_moves(cube: DataFrame) -> DataFrame:
    """(feature, week, prev_n, fraction): share moving to n-1 or n+1."""
    near = F.abs(F.col("prev_n") - F.col("cur_n")) == 1
    return (cube.groupBy("feature", "week_no", "week", "prev_n")
                .agg(_ratio(F.sum(F.when(near, F.col("pages")).otherwise(0)), F.sum("pages")).alias("fraction")))


def neighbour_moves3(cube: DataFrame) -> DataFrame:
    """(feature, week, prev_class, fraction): share moving to a neighbouring class."""
    near = F.abs(_class3(F.col("prev_n")) - _class3(F.col("cur_n"))) == 1
    return (cube.groupBy("feature", "week_no", "week", _class3(F.col("prev_n")).alias("prev_class"))
                .agg(_ratio(F.sum(F.when(near, F.col("pages")).otherwise(0)), F.sum("pages")).alias("fraction")))


def daily_changes(bits: DataFrame, limit_weekday: int | None = None) -> DataFrame:
    """(feature, day_no, changed, fraction): changed pages per day pair.

    day_no counts from the first day2 present.  With ``limit_weekday``
    (0 = Monday) only pairs whose first day falls on that weekday are kept and
    day_no becomes the week number since the start.  Missing numbers are
    filled with zero; fraction divides by the number of pages.
    """
    per_day = (bits.groupBy("day2")
                   .agg(*[F.sum(c).cast("bigint").alias(f) for f, c in FEATURE_BITS.items()]))
    # Tiny table (one row per crawl day): whole-table windows are cheap here.
    start = F.min("day2").over(Window.partitionBy())
    days = per_day.withColumn("day_no", D.day_number("day2", start))
    if limit_weekday is not None:
        days = (days.filter(D.pair_weekday("day2") == limit_weekday)
                    .withColumn("day_no", F.floor(F.col("day_no") / 7).cast("int")))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("changed")) for f in FEATURE_BITS])
    long = (days.select("day_no", F.explode(cells).alias("_c"))
                .groupBy("_c.feature", "day_no").agg(F.sum("_c.changed").alias("changed")))
    n_pages = bits.agg(F.count_distinct("page_id")).first()[0]  # one scalar
    span = long.groupBy().agg(F.max("day_no").alias("_last"))
    grid = (span.select(F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("day_no"))
                .select(F.explode(F.array(*[F.lit(f) for f in FEATURE_BITS])).alias("feature"), "day_no"))
    dense = grid.join(long, ["feature", "day_no"], "left").select(
        "feature", "day_no", F.coalesce("changed", F.lit(0)).cast("bigint").alias("changed"))
    return dense.withColumn("fraction", F.try_divide(F.col("changed").cast("double"), F.lit(float(n_pages or 0))))


def changes_per_page(bits: DataFrame, bit: str = "text_changed") -> DataFrame:
    """(page_id, changes): number of day pairs in which the page changed."""
    return bits.filter(F.col(bit) == 1).groupBy("page_id").agg(F.count(F.lit(1)).alias("changes"))


def rare_changes(bits: DataFrame, n_pairs: int, threshold_fraction: float = 0.1,
                 bit: str = "text_changed") -> DataFrame:
    """(day2, rare_changes): changed pages per day among pages that change in
    fewer than ``n_pairs * threshold_fraction`` day pairs."""
    changed = bits.filter(F.col(bit) == 1).select("page_id", "day2")
    rare = (changed.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n"))
                   .filter(F.col("_n") < n_pairs * threshold_fraction).select("page_id"))
    return (changed.join(rare, "page_id", "left_semi")
                   .groupBy("day2").agg(F.count(F.lit(1)).alias("rare_changes")))


def day_change_curve(bits: DataFrame, n_pairs: int, bit: str = "text_changed") -> DataFrame:
    """(position, percentile, fraction): per-page change fractions sorted descending
    against an even 0..100 axis.  Pages are counted by their number of changes, never ranked."""
    per_page = changes_per_page(bits, bit).select(F.lit("pages").alias("_all"), "changes")
    curve = rank_curve(histogram(per_page, "_all", "changes", descending=True), [], "changes")
    return curve.select("position", "percentile", (F.col("changes") / F.lit(float(n_pairs))).alias("fraction"))

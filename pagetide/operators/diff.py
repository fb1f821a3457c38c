"""Day-over-day comparison of page feature lists.

Pairs are consecutive crawl days of the same page.  All days of a page meet in one exchange by page key; there ``lag``
gives every snapshot the one before, and the pair counts if the list of crawl days has nothing between the
two.  For change bits only MD5 digests and list sizes are shuffled, never the lists themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions.udfs import matched_elements


def crawl_days(snapshots: DataFrame, day: str = "day") -> list:
    """The ordered crawl days (one row per day of the study, read from the day column alone)."""
    return sorted(r[0] for r in snapshots.select(day).where(F.col(day).isNotNull()).distinct().collect())


def digest(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.md5(F.to_json(col))


def day_pairs(snapshots: DataFrame, features: list[str], key: str = "page_id", day: str = "day",
              left: list[str] | None = None, right: list[str] | None = None, days: list | None = None) -> DataFrame:
    """(key, day1, day2, <col>_1..., <col>_2...) for consecutive crawl days.

    ``left``/``right`` are the columns taken from day 1 / day 2 (default: the feature columns on both sides).
    ``days`` is the crawl calendar; where it is not given it is read from the snapshots.  A page has one snapshot a day;
    snapshots without key or day belong to no pair, and days that a page misses break its sequence.
    """
    left = left if left is not None else features
    right = right if right is not None else features
    days = crawl_days(snapshots, day) if days is None else sorted(days)
    calendar = F.array(*[F.lit(d) for d in days]).cast(f"array<{snapshots.schema[day].dataType.simpleString()}>")
    before = F.lag(F.struct(F.col(day).alias("day"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(left)])).over(
        Window.partitionBy(key).orderBy(day))
    paired = (snapshots.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(key, day, *dict.fromkeys([*left, *right]))
                       .select(key, day, *right, before.alias("_before")))
    follows = F.array_position(calendar, F.col(day)) == F.array_position(calendar, F.col("_before.day")) + 1
    return paired.where(follows).select(key, F.col("_before.day").alias("day1"), F.col(day).alias("day2"),
                                        *[F.col(f"_before.c{i}").alias(c + "_1") for i, c in enumerate(left)],
                                        *[F.col(c).alias(c + "_2") for c in right])


def change_bits(snapshots: DataFrame, features: list[str], key: str = "page_id", day: str = "day",
                days: list | None = None) -> DataFrame:
    """(key, day1, day2, <feature>_changed): order-sensitive list inequality,
    computed on digests so that only 32-character hashes cross the shuffle."""
    dig = snapshots.select(key, day, *[digest(f).alias(f) for f in features])
    pairs = day_pairs(dig, features, key, day, days=days)
    return pairs.select(key, "day1", "day2",
                        *[(~F.col(f + "_1").eqNullSafe(F.col(f + "_2"))).cast("int").alias(f + "_changed") for f in features])


def feature_numbers(snapshots: DataFrame, features: list[str], key: str = "page_id", day: str = "day") -> DataFrame:
    """(key, day, <feature>): list lengths."""
    return snapshots.select(key, day, *[F.size(f).alias(f) for f in features])


def training_pairs(snapshots: DataFrame, features: list[str], targets: list[str], key: str = "page_id",
                   day: str = "day", days: list | None = None) -> DataFrame:
    """(key, day1, <feature sizes on day 1>, <target>_changed): static training pairs."""
    pre = snapshots.select(key, day, *[F.size(f).alias("n_" + f) for f in features],
                           *[digest(t).alias("d_" + t) for t in targets])
    pairs = day_pairs(pre, [], key, day, left=[*("n_" + f for f in features), *("d_" + t for t in targets)],
                      right=["d_" + t for t in targets], days=days)
    return pairs.select(key, "day1", *[F.col(f"n_{f}_1").alias(f) for f in features],
                        *[(~F.col(f"d_{t}_1").eqNullSafe(F.col(f"d_{t}_2"))).cast("int").alias(t + "_changed")
                          for t in targets])


def opcode_struct(a: Column, b: Column) -> Column:
    """(equal, insert, delete) of two lists; equal lists and empty sides are
    answered natively, the alignment UDF runs only for real differences."""
    # A missing list counts as empty.
    la, lb = F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(b), F.lit(0))
    la, lb = F.greatest(la, F.lit(0)), F.greatest(lb, F.lit(0))
    same = a.eqNullSafe(b)
    native = (F.when(same, F.struct(la.alias("equal"), F.lit(0).alias("insert"), F.lit(0).alias("delete")))
               .when(la == 0, F.struct(F.lit(0).alias("equal"), lb.alias("insert"), F.lit(0).alias("delete")))
               .when(lb == 0, F.struct(F.lit(0).alias("equal"), F.lit(0).alias("insert"), la.alias("delete"))))
    # Python UDFs run on every row: rows answered natively pass nulls (no transfer, no work).
    needs = ~same & (la > 0) & (lb > 0)
    equal = matched_elements(F.when(needs, a), F.when(needs, b))
    aligned = F.struct(equal.alias("equal"), (lb - equal).alias("insert"), (la - equal).alias("delete"))
    return F.coalesce(native, aligned)


def feature_diff(snapshots: DataFrame, features: list[str], key: str = "page_id", day: str = "day",
                 page_hash: str | None = "page_hash", days: list | None = None) -> DataFrame:
    """Long form (key, day1, day2, feature, equal, insert, delete) per list
    feature, plus a ``page_hash`` row with insert = 1 when the digest changed."""
    cols = features + ([page_hash] if page_hash else [])
    pairs = day_pairs(snapshots, cols, key, day, days=days)
    cells = [F.struct(F.lit(f).alias("feature"), opcode_struct(F.col(f + "_1"), F.col(f + "_2")).alias("ops"))
             for f in features]
    if page_hash:
        changed = (~F.col(page_hash + "_1").eqNullSafe(F.col(page_hash + "_2"))).cast("int")
        cells.append(F.struct(F.lit("page_hash").alias("feature"),
                              F.struct((1 - changed).alias("equal"), changed.alias("insert"),
                                       F.lit(0).alias("delete")).alias("ops")))
    return (pairs.select(key, "day1", "day2", F.explode(F.array(*cells)).alias("_c"))
                 .select(key, "day1", "day2", "_c.feature", "_c.ops.equal", "_c.ops.insert", "_c.ops.delete"))


def combine_features(frames: dict[str, DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """(keys, a column per frame, missing, repeated): per-feature lists of one value per key put side by side.

    All frames meet in one exchange by key.  Their keys have to agree: ``missing`` names the features that lack a key and
    ``repeated`` those that hold it more than once, both empty where all is well (``disagreements`` has the other rows).
    Of a repeated key the smallest value is taken; null keys are keys.
    """
    names = list(frames)
    rows = None
    for name, frame in frames.items():
        part = frame.select(*keys, F.lit(name).alias("_feature"), F.col(value).alias("_value"))
        rows = part if rows is None else rows.unionByName(part)
    of = {name: F.col("_feature") == name for name in names}
    wide = rows.groupBy(*keys).agg(*[F.min(F.when(of[n], F.col("_value"))).alias(n) for n in names],
                                   *[F.count_if(of[n]).alias(f"_n{i}") for i, n in enumerate(names)])

    def named(test):
        return F.array_compact(F.array(*[F.when(test(F.col(f"_n{i}")), F.lit(n)) for i, n in enumerate(names)]))

    return wide.select(*keys, *names, named(lambda c: c == 0).alias("missing"), named(lambda c: c > 1).alias("repeated"))


def disagreements(combined: DataFrame) -> DataFrame:
    """The keys of ``combine_features`` that some feature lacks or repeats."""
    return combined.where((F.size("missing") > 0) | (F.size("repeated") > 0))


def diff_totals(diff: DataFrame, feature: str, include_equal: bool = True) -> DataFrame:
    """Total equal / insert / delete of one feature; ``include_equal=False`` skips unchanged pairs."""
    d = diff.filter(F.col("feature") == feature)
    if not include_equal:
        d = d.filter((F.col("insert") != 0) | (F.col("delete") != 0))
    return d.agg(F.sum("equal").cast("bigint").alias("equal"), F.sum("insert").cast("bigint").alias("insert"),
                 F.sum("delete").cast("bigint").alias("delete"))


BROADCAST_PAIRS = 10_000


def changed_sample(snapshots: DataFrame, feature: str, n: int, key: str = "page_id", day: str = "day",
                   seed: int = 42, days: list | None = None) -> DataFrame:
    """n pairs whose feature differs, chosen by seeded-hash order, with the lines
    only in day 1 (``removed``) and only in day 2 (``added``).

    The choice runs on digests (top-n, no global sort); only the n chosen
    pages' full lists are then fetched, in one read (up to ``BROADCAST_PAIRS`` chosen pairs are broadcast).
    """
    dig = snapshots.select(key, day, digest(feature).alias("_d"))
    pairs = day_pairs(dig, ["_d"], key, day, days=days)
    order = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"), F.col("day1").cast("string")))
    picked = (pairs.filter(~F.col("_d_1").eqNullSafe(F.col("_d_2"))).withColumn("_o", order)
                   .orderBy("_o", key).limit(n).select(key, "day1", "day2"))
    # Both days of every chosen pair in one read of the lists.
    sides = picked.select(key, "day1", "day2", F.explode(F.array(F.col("day1"), F.col("day2"))).alias(day))
    chosen = F.broadcast(sides) if n <= BROADCAST_PAIRS else sides
    sided = snapshots.select(key, day, feature).join(chosen, [key, day])
    both = sided.groupBy(key, "day1", "day2").agg(F.first(F.when(F.col(day) == F.col("day1"), F.col(feature)), ignorenulls=True).alias("_a"),
                                                  F.first(F.when(F.col(day) == F.col("day2"), F.col(feature)), ignorenulls=True).alias("_b"))
    return both.select(key, "day1", "day2", F.array_except("_a", "_b").alias("removed"),
                       F.array_except("_b", "_a").alias("added"))


def crawl_change_bits(clean_pages: DataFrame, features=("text", "internal_outlinks", "external_outlinks"),
                      url: str = "url", html: str = "html", days: list | None = None) -> DataFrame:
    """Change bits of cleaned crawl pages between consecutive crawl days.

    ``clean_pages`` is the output of ``crawl.clean_crawl`` (day, page_key, url,
    html, ...).  Feature lists are extracted per page-day (map-only; ``text_lines`` are taken as they are), digested,
    and paired by page key across the crawl calendar.
    """
    from pagetide.operators.pages import page_feature_lists
    text = "text_lines" if "text_lines" in clean_pages.columns else None
    lists = page_feature_lists(clean_pages, keys=("day", "page_key"), url=url, html=html, text=text)
    bits = change_bits(lists, list(features), key="page_key", day="day", days=days)
    return bits.withColumnRenamed("page_key", "page_id")

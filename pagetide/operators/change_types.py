"""Which features change, how much, and what kind of change it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed vocabularies.
INFORMATIVE = ("text", "internal_outlinks", "external_outlinks", "email_links", "images", "tables")
USEFUL_CATEGORIES = ("News headline", "New content", "Updated agenda", "User reply")


def _changed(c: Column) -> Column:
    return ~c.getField("a").eqNullSafe(c.getField("b"))


def change_fractions(pairs: DataFrame, features: list[str]) -> DataFrame:
    """(feature, fraction): share of page pairs in which the feature list changed.

    ``pairs`` holds ``<feature>_1`` / ``<feature>_2``; a list changed exactly when
    its diff has an insert or a delete, i.e. when the lists differ.
    """
    sums = [F.avg((~F.col(f + "_1").eqNullSafe(F.col(f + "_2"))).cast("double")).alias(f) for f in features]
    wide = pairs.agg(*sums)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("fraction")) for f in features])
    return wide.select(F.explode(cells).alias("_c")).select("_c.feature", "_c.fraction")


def informative_split(pairs: DataFrame, features: list[str], page_hash: str = "page_hash",
                      informative=INFORMATIVE) -> DataFrame:
    """(both, only_informative, only_uninformative, neither) counts among pairs
    whose page hash changed."""
    def any_changed(fs):
        flags = [~F.col(f + "_1").eqNullSafe(F.col(f + "_2")) for f in fs]
        out = F.lit(False)
        for fl in flags:
            out = out | fl
        return out

    inf = any_changed([f for f in features if f in informative])
    un = any_changed([f for f in features if f not in informative])
    hashed = pairs.filter(F.col(page_hash + "_1") != F.col(page_hash + "_2"))

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    return hashed.agg(cnt(inf & un).alias("both"), cnt(inf & ~un).alias("only_informative"),
                      cnt(~inf & un).alias("only_uninformative"), cnt(~inf & ~un).alias("neither"))


def change_amplitudes(diff: DataFrame) -> DataFrame:
    """(feature, insert_share, delete_share): mean share of inserted / deleted
    elements among changed pairs, sorted by their sum (descending)."""
    total = (F.col("equal") + F.col("insert") + F.col("delete")).cast("double")
    changed = diff.filter((F.col("feature") != "page_hash") & ((F.col("insert") != 0) | (F.col("delete") != 0)))
    return (changed.groupBy("feature")
                   .agg(F.avg(F.col("insert") / total).alias("insert_share"),
                        F.avg(F.col("delete") / total).alias("delete_share"))
                   .orderBy(F.desc(F.col("insert_share") + F.col("delete_share"))))


def category_shares(labels: DataFrame, categories: str = "categories") -> DataFrame:
    """(category, share): share of labelled pages carrying each category,
    ordered by count desc then name."""
    cats = labels.select(F.array_distinct(F.split(F.col(categories), ",")).alias("_cs"))
    n = labels.count()  # one scalar
    counts = cats.select(F.explode("_cs").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("_c"))
    return (counts.select("category", F.try_divide(F.col("_c").cast("double"), F.lit(float(n))).alias("share"), "_c")
                  .orderBy(F.desc("_c"), "category").drop("_c"))


def useful_share(labels: DataFrame, useful=USEFUL_CATEGORIES, categories: str = "categories") -> DataFrame:
    """One row: share of labelled pages with at least one useful category."""
    cats = F.split(F.col(categories), ",")
    hit = F.arrays_overlap(cats, F.array(*[F.lit(u) for u in useful]))
    return labels.agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("useful_share"),
                      F.count(F.lit(1)).alias("pages"))

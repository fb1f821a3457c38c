"""Operator 2: mixing sources to target weights.

Tokens are summed per source (partial aggregation, so a source with a third of all rows costs no
more than any other), the targets give each source a repetition rate, and every document is emitted
floor(rate) times plus one more copy with the fraction's probability, drawn from a hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.operators.ordering import dense_index

from .common import cut, unit_hash

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
# Rates are broadcast only below this many bytes of sources; beyond it the join shuffles.
RATES_BROADCAST_BYTES = 4 << 20


def source_rates(docs: DataFrame, source: str, size: Column, weights: Sequence[int] = WEIGHTS,
                 max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) per source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the total of all
    sizes.  A target stops at ``max_repeats`` times its source's size; the excess goes to the others
    by weight until no target is above.  Each round is one aggregate over the per-source table;
    only its sums reach the driver.  A source of size 0 has target and rate 0; no documents, no rows.
    """
    totals = (docs.select(F.col(source).alias("source"), size.alias("size"))
                  .groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = dense_index(totals, [], [F.col("source").isNull(), F.col("source")], name="position")
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                        ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    table = cut(ranked.select("source", "source_size", pick.cast("long").alias("weight"),
                              (F.col("source_size") * max_repeats).alias("cap")))
    whole = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total, open_weight = whole[0] or 0, whole[1] or 0
    level, capped = 0.0, -1
    remaining = total
    while open_weight:
        level = remaining / open_weight
        full = F.col("weight") * F.lit(level) > F.col("cap")
        row = table.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("cap")).otherwise(0)),
                        F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if row[0] == capped:
            break
        capped, remaining, open_weight = row[0], total - row[1], row[2]
    share = F.col("weight") * F.lit(level)
    target = F.when(share > F.col("cap"), F.col("cap").cast("double")).otherwise(share)
    return (table.withColumn("target", target)
                 .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                                      .otherwise(F.lit(0.0)))
                 .drop("weight", "cap"))


def with_copies(docs: DataFrame, doc_id: str, text: str, source: str, size: Column, seed: str = "mix",
                weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """All columns of ``docs`` and a struct ``__mix`` (size, source_size, target, rate, copies).

    The same id always draws the same number, so reruns agree and repeated rows go together; a row
    without an id draws by its text.  A column called ``__mix`` in the input is replaced.
    """
    rates = source_rates(docs, source, size, weights, max_repeats)
    width = rates.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 48)).first()[0] or 0
    rates = rates.select(F.struct("source", "source_size", "target", "rate").alias("__rate"))
    rates = F.broadcast(rates) if width <= RATES_BROADCAST_BYTES else rates
    sized = docs.drop("__mix").withColumn("__size", size)
    joined = sized.join(rates, F.col("__rate.source").eqNullSafe(sized[source]), "left")
    draw = unit_hash(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text)), F.lit("")))
    rate = F.col("__rate.rate")
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")
    return (joined.withColumn("__mix", F.struct(F.col("__size").alias("size"), F.col("__rate.source_size"),
                                                F.col("__rate.target"), rate, copies.alias("copies")))
                  .drop("__rate", "__size"))


def mixed(docs: DataFrame, doc_id: str, text: str, source: str, size: Column, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    counted = with_copies(docs, doc_id, text, source, size, **options)
    taken = counted.where("__mix.copies > 0")
    return (taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix.copies"))))
                 .select(*[F.col(f"`{c}`") for c in docs.columns]))

"""Change bits as crawl days arrive (Structured Streaming).

Each crawl day lands as new parquet files of page features.  The stream
digests every feature list, drops further snapshots of a page and day, and joins
itself by page and place in the crawl calendar, as first and as second day of a pair: two stateful operators of Spark's
own, no Python per page.  A pair is emitted once both of its days are there, in whatever order they
came; which days are neighbours is settled by the crawl calendar, as in the batch operator.  Only MD5 digests (16 bytes) travel and sit
in state, one entry per page and calendar day on either side of the join.  The
checkpoint lives under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.operators.diff import digest
from pagetide.session import ensure_checkpoint_dir


def change_bits_stream(spark: SparkSession, source_dir: str, feature_schema: T.StructType, features: list[str],
                       sink_dir: str, name: str = "change_bits", available_now: bool = True, days: list[dt.date] | None = None):
    """Start the stream; returns the ``StreamingQuery``.  ``feature_schema`` must
    hold ``page_id`` (string), ``day`` (date) and the list features.  ``days`` is the crawl calendar (a row of a day that is not in it
    has no pair); without it every calendar day is a crawl day.  Rows that come late are paired when they come."""
    stream = spark.readStream.schema(feature_schema).parquet(source_dir)
    date = F.col("day").cast("date")
    if days:
        calendar = F.array(*[F.lit(d) for d in sorted(set(days))])
        place = F.nullif(F.array_position(calendar, date), F.lit(0))
    else:
        place = F.unix_date(date)
    digests = stream.select(F.col("page_id").cast("string").alias("page_id"), date.alias("day"), place.alias("at"),
                            *[F.unhex(digest(f)).alias(f"d{i}") for i, f in enumerate(features)])
    seen = digests.dropDuplicates(["page_id", "day"])  # a page has one snapshot a day: the first one counts
    values = [f"d{i}" for i in range(len(features))]
    one = seen.select(F.col("page_id").alias("page1"), F.col("day").alias("day1"), (F.col("at") + 1).alias("at1"), *[F.col(v).alias(v + "_1") for v in values])
    two = seen.select("page_id", F.col("day").alias("day2"), F.col("at").alias("at2"), *[F.col(v).alias(v + "_2") for v in values])
    pairs = one.join(two, one["page1"].eqNullSafe(two["page_id"]) & (one["at1"] == two["at2"]))
    bits = pairs.select("page_id", "day1", "day2", *[(~F.col(v + "_1").eqNullSafe(F.col(v + "_2"))).cast("int").alias(f + "_changed")
                                                     for v, f in zip(values, features, strict=True)])
    checkpoint = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    writer = (bits.writeStream.format("parquet").option("path", sink_dir)
                  .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_bits(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir)

"""Interval semi-join of crawl-log rows against threat times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions.dates import truncate_to_second

# Fixed values of the threat list: its time column and the format of the times.
THREAT_TIME_COLUMN = "Occured on"
THREAT_TIME_FORMAT = "dd-MM-yyyy HH:mm:ss"


def read_threats(spark: SparkSession, path: str, column: str = THREAT_TIME_COLUMN) -> DataFrame:
    """(ts): the times of a threat list saved as CSV with a header.

    A time that cannot be parsed fails the job: a threat left out would clear the pages near it.
    An empty time is null and matches nothing."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.to_timestamp_ntz(F.col(f"`{column}`"), F.lit(THREAT_TIME_FORMAT)).alias("ts"))


def _second(ts) -> Column:
    """Whole seconds since 1970 of a time without its fraction."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", origin, truncate_to_second(F.col(ts)).cast("timestamp_ntz"))


def threat_bins(threats: DataFrame, seconds: int = 10, ts: str = "ts") -> DataFrame:
    """(bin, earliest, latest_before): time in bins as long as the window.

    A row lies in a window if a threat of its own bin is not later than it, or one of the bin before is at most
    ``seconds`` older.  So a bin's earliest threat and the latest one of the bin before decide: one row per bin that a threat
    reaches, however long the window and however many the threats.
    """
    width = max(seconds, 1)
    at = threats.where(F.col(ts).isNotNull()).select(_second(ts).alias("_s"))
    reach = at.select(F.explode(F.array(
        F.struct(F.floor(F.col("_s") / width).alias("bin"), F.col("_s").alias("own"), F.lit(None).cast("bigint").alias("before")),
        F.struct((F.floor(F.col("_s") / width) + 1).alias("bin"), F.lit(None).cast("bigint").alias("own"), F.col("_s").alias("before")))).alias("x"))
    return reach.groupBy("x.bin").agg(F.min("x.own").alias("earliest"), F.max("x.before").alias("latest_before"))


def flag_threat_window(logs: DataFrame, threats: DataFrame, seconds: int = 10, ts: str = "ts") -> DataFrame:
    """Log rows whose time, without its fraction of a second, falls within ``seconds`` after a threat.

    An equi semi-join on the time bin with an exact check: each log row meets at most one row. The threat side is not force-broadcast (it may grow with the
    data); AQE turns the join into a broadcast when the runtime size allows.
    """
    wanted = threat_bins(threats, seconds, ts).withColumnRenamed("bin", "__bin")
    at = _second(ts)
    inside = F.coalesce(at >= F.col("earliest"), F.lit(False)) | F.coalesce(at <= F.col("latest_before") + seconds, F.lit(False))
    timed = logs.withColumn("__at", F.floor(at / max(seconds, 1)))
    return timed.join(wanted, (F.col("__at") == F.col("__bin")) & inside, "left_semi").drop("__at")

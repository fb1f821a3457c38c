"""Readers for the parquet tables the engine works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Tables whose rows carry whole pages / documents: per-row work (regex, text
# splitting, alignment) dominates, so the map stage needs at least one task
# per core, and of a large table as many more as keep a task short.
TEXT_HEAVY = frozenset({"pages", "documents"})
TASK_BYTES = 4 << 20  # of files, which hold a text in about half its size
TASKS_PER_CORE = 32


def read_table(spark: SparkSession, root: str, name: str, min_partitions: int | None = None) -> DataFrame:
    """One parquet table; Catalyst prunes columns and pushes filters into the scan.

    With ``min_partitions``, a table stored in fewer splits (e.g. one large row
    group), or in fewer than one for each ``TASK_BYTES`` of its files, is spread round-robin right after the scan;
    column pruning and filters still reach the scan below the exchange.  Inputs that
    have ``TASKS_PER_CORE`` times as many splits are left as they are.
    """
    path = f"{root.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    if min_partitions:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0  # listed, not read
        wanted = max(min_partitions, min(size // TASK_BYTES, TASKS_PER_CORE * min_partitions))
        if df.rdd.getNumPartitions() < wanted:
            df = df.repartition(wanted)
    return df


class Tables:
    """Lazy accessor: ``Tables(spark, root).pages`` reads ``<root>/pages.parquet``."""

    def __init__(self, spark: SparkSession, root: str, spread: bool = True):
        self.spark, self.root, self.spread = spark, root, spread

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            min_parts = self.spark.sparkContext.defaultParallelism if self.spread and name in TEXT_HEAVY else None
            return read_table(self.spark, self.root, name, min_parts)
        raise AttributeError(name)

"""Writers and checkpoints.  Outputs stay partitioned (no ``coalesce(1)``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.session import ensure_checkpoint_dir


def write_csv(df: DataFrame, path: str, lead: list[str], mode: str = "overwrite") -> None:
    """CSV with header: ``lead`` columns first, the others in name order."""
    rest = sorted(c for c in df.columns if c not in lead)
    df.select(*lead, *rest).write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", files: int = 8,
                  spread_by: str | None = None) -> None:
    """Parquet data set.  With ``partition_by`` the rows of a partition value are gathered first, in at most ``files`` tasks
    (dealt out by ``spread_by``, or by the whole row), so a day is a few files and not one per task."""
    if not partition_by:
        df.write.mode(mode).option("compression", "zstd").parquet(path)
        return
    spread = F.xxhash64(*([spread_by] if spread_by else [c for c, t in df.dtypes if not t.startswith("map")]))
    dealt = df.withColumn("_file", F.pmod(spread, F.lit(files)))
    (dealt.repartition(*partition_by, "_file").drop("_file")
          .write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path))


def write_page_table(df: DataFrame, table: str, key: list[str], buckets: int, sort_by: list[str] | None = None) -> DataFrame:
    """A table in the warehouse, bucketed and sorted by ``key``.  Tables with the same key and number of buckets are joined,
    and grouped by the key, without an exchange.  Rows are dealt out by the key first: one file per bucket."""
    (df.repartition(buckets, *key).write.mode("overwrite").format("parquet").option("compression", "zstd")
       .bucketBy(buckets, *key).sortBy(*key, *(sort_by or [])).saveAsTable(table))
    return df.sparkSession.table(table)


def write_feature_csvs(df: DataFrame, root: str, names: list[str], keys=("stage_file", "url_index")) -> None:
    """One CSV per feature (keys + feature), rows key-sorted inside each file.
    Joins on the keys do not need the order; it only makes files diffable.  The input is worked out once, in
    the shared folder, and each feature is read from there."""
    flat = df.select(*keys, *[F.col(name).cast("string").alias(name) for name in names])
    held = save_checkpoint(flat, f"features-{uuid.uuid4().hex}")
    for name in names:
        (held.select(*keys, name).sortWithinPartitions(*keys)
             .write.mode("overwrite").option("header", True).csv(f"{root.rstrip('/')}/{name}"))


def write_stage_files(staged: DataFrame, path: str, width: int = 2) -> None:
    """One text directory per stage (``stage=links_s00`` ...), one link per line."""
    named = staged.select(F.concat(F.lit("links_s"), F.lpad(F.col("stage").cast("string"), width, "0")).alias("stage"),
                          "link")
    named.write.mode("overwrite").partitionBy("stage").text(path)


def save_checkpoint(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write a data set under the shared checkpoint folder and read it back
    (lineage cut, survives executor loss)."""
    root = root or ensure_checkpoint_dir(df.sparkSession)
    path = f"{root.rstrip('/')}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def load_checkpoint(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    root = root or ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def preview(df: DataFrame, key: str, digest_of: str, n: int = 10) -> dict:
    """Column names, a few keys with content digests, and the row count."""
    sample = [r.asDict() for r in df.select(key, F.md5(F.col(digest_of).cast("string")).alias("md5")).limit(n).collect()]
    return {"columns": df.columns, "sample": sample, "count": df.count()}

"""Spark session helpers.

Cluster settings come from ``spark-submit``; ``get_spark`` only fills in what
is unset so that the same code runs in tests (``local[*]``) and on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on.  Applied with ``setIfMissing`` semantics.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # ordering.dense_index reads one range exchange from two branches; reuse keeps them identical.
    "spark.sql.exchange.reuse": "true",
    # Checkpoint files of unreferenced data sets are removed by the context cleaner.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Page-sized lists travel to the alignment UDF: keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # A batch also ends at so many bytes: rows may hold whole documents of many megabytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

# Suggested settings for a large cluster (passed with spark-submit --conf; not
# applied here).  Rows carry pages of up to 10 MiB, so input splits and shuffle
# partitions are kept small and AQE merges what turns out tiny.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "3 x total executor cores (AQE coalesces)",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.checkpoint.dir": "shared storage (HDFS / object store), never a local disk",
    "spark.task.maxFailures": "8",
    # Streaming state (digests per page) kept off-heap and checkpointed incrementally.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pagetide") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    given = _submitted()
    for key, value in DEFAULT_CONF.items():
        if key not in given:
            builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def _submitted() -> set[str]:
    """Names of the settings that spark-submit passed on (it starts the JVM before this process asks for it)."""
    if not os.environ.get("PYSPARK_GATEWAY_PORT"):
        return set()
    SparkContext._ensure_initialized()
    return {key for key, _ in SparkConf(_jvm=SparkContext._jvm).getAll()}


def prepare(spark: SparkSession) -> None:
    """What every query needs of a session, whoever built it: the shared folder and the package."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    # Whole documents and pages travel to Python: small batches, unless the application chose a size.
    for limit in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        key = f"spark.sql.execution.arrow.{limit}"
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, DEFAULT_CONF[key])


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    ``spark-submit`` of a script, or a notebook that extends ``sys.path``, makes the package known to
    the driver only; functions that run in workers are found there through this archive.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pagetide_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pagetide-"), "pagetide.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._pagetide_shipped = True


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: worked out once, however often it is used."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point to shared storage and is taken as
    given.  Only when it is unset (tests, local runs) a fresh scratch folder is
    created for this process.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="pagetide-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured

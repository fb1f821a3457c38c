"""Run one named query and write its result (spark-submit friendly).

    spark-submit pagetide/__main__.py <query> <table_dir> <output_dir> [--format parquet|csv]
    python -m pagetide --list [--module pagetide.plans.catalog]

Cluster settings (executors, shuffle partitions, spark.checkpoint.dir) come
from spark-submit; the engine's own defaults fill in what is unset there.  ``--module``
names any module with a table ``QUERIES`` of (spark, table_dir) functions.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagetide.session import get_spark  # noqa: E402


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="pagetide")
    ap.add_argument("query", nargs="?")
    ap.add_argument("table_dir", nargs="?")
    ap.add_argument("output_dir", nargs="?")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--module", default="pagetide.plans.catalog", help="module that holds the queries")
    ap.add_argument("--list", action="store_true", help="print the query names and exit")
    args = ap.parse_args(argv)
    queries = importlib.import_module(args.module).QUERIES
    if args.list or not args.query:
        print("\n".join(sorted(queries)))
        return 0
    if args.query not in queries or not (args.table_dir and args.output_dir):
        ap.error("need a known query, a table dir and an output dir (see --list)")
    spark = get_spark(app_name=f"pagetide-{args.query}")
    df = queries[args.query](spark, args.table_dir)
    writer = df.write.mode("overwrite")
    if args.format == "csv":
        writer.option("header", True).csv(args.output_dir)
    else:
        writer.option("compression", "zstd").parquet(args.output_dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())

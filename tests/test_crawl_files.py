"""Rejected log lines, plain CSV, packed page files, bounded day files, bucketed page tables."""
import os

from pyspark.sql import functions as F

from pagetide.operators import crawl as C
from pagetide.sources import files as FS
from pagetide.sources import sinks

HEADER = "Stage file,URL index,Status code,Timestamp,File present,URL\n"
OK = "RequestStatus.HEADLESS_SUCCESS"


def _day(root, name, lines):
    os.makedirs(os.path.join(root, name), exist_ok=True)
    with open(os.path.join(root, name, "log-thread-3.csv"), "w") as f:
        f.write(HEADER + "\n".join(lines) + "\n")


def test_broken_lines_are_kept_apart_and_counted(spark, tmp_path):
    _day(str(tmp_path), "20210612-run", [f"links_s00,1,{OK},20210612101500,True,http://a.nl", f"links_s00,2,{OK},20210612101500",
                                         f"links_s00,x3,{OK},20210612101500,True,http://c.nl", f"links_s00,4,{OK},yesterday,True,http://d.nl",
                                         f"link\x00s_s01,5,{OK},20210612101500,True,http://e\x00.nl", f"links,6,{OK},20210612101500,True,http://f.nl",
                                         f"links_s00,7,{OK},20210612101500,True,http://g.nl,extra"])
    _day(str(tmp_path), "undated", [f"links_s02,1,{OK},20210613101500,True,http://h.nl"])
    glob = os.path.join(str(tmp_path), "*", "*.csv")
    rows = {r["page_key"]: r for r in C.read_crawl_logs(spark, glob).collect()}
    assert sorted(rows) == ["links_s00-1", "links_s00-4", "links_s01-5", "links_s02-1"]
    assert rows["links_s00-4"]["ts"] is None and rows["links_s02-1"]["day"] is None and rows["links_s01-5"]["url"] == "http://e.nl"
    counts = sorted(tuple(r)[1:] for r in C.log_line_counts(spark, glob).collect())
    assert counts == [(1, 0, 0, 0, 0, 0, 1), (7, 4, 2, 1, 1, 1, 0)]  # lines, rejected, columns, index, stage, time, day
    # One column is enough to tell: the reader is not pruned.
    assert C.read_crawl_logs(spark, glob).select("url").count() == 4
    bad = {(r["page_key"], tuple(r["defects"])): r["line"] for r in C.rejected_log_lines(spark, glob).collect()}
    assert sorted(bad) == [("links-6", ("stage",)), ("links_s00-2", ("columns",)), ("links_s00-7", ("columns",)), ("links_s00-x3", ("index",))]
    assert any(line and line.endswith("extra") for line in bad.values())


def test_plain_csv_without_nuls(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Pa\x00ge,Categories,Note\ns00-1,\x00News,a\x00b\ns00-2,,\n".encode())
    df = FS.read_plain_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Page", "Categories", "Note"]
    assert sorted(tuple(r) for r in df.collect()) == [("s00-1", "News", "ab"), ("s00-2", None, None)]


def test_packed_pages_are_the_pages(spark, tmp_path):
    folders = []
    for day in ("20210612", "20210613"):
        folder = os.path.join(str(tmp_path), f"{day}-run", "pages")
        os.makedirs(folder)
        folders.append(folder)
        for i in range(30):
            with open(os.path.join(folder, f"links_s00-{i}"), "wb") as f:
                f.write(b"\xff\xfe" if i == 7 else f"<html>{day} {i}</html>".encode())
    target = str(tmp_path / "packed")
    packed = C.pack_page_files(spark, folders, target)
    single = C.read_page_blobs(spark, os.path.join(str(tmp_path), "*", "pages"))
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, single.collect())) and packed.count() == 60
    again = C.pack_page_files(spark, folders[:1], target)  # a day replaces itself
    assert again.count() == 60
    files = [f for _, _, names in os.walk(target) for f in names if f.endswith(".parquet")]
    assert len(files) == 2


def test_days_are_a_few_files(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") % 3).alias("day"), F.col("id").alias("page_key")).repartition(40)
    sinks.write_parquet(df, str(tmp_path / "days"), partition_by=["day"], files=2)
    per_day = [len([f for f in os.listdir(tmp_path / "days" / d) if f.endswith(".parquet")]) for d in os.listdir(tmp_path / "days") if d.startswith("day=")]
    assert len(per_day) == 3 and max(per_day) <= 2
    assert spark.read.parquet(str(tmp_path / "days")).count() == 4000


def test_bucketed_page_tables_join_without_an_exchange(spark):
    base = spark.range(500).select(F.concat(F.lit("links_s00-"), F.col("id").cast("string")).alias("page_key"), F.lit("2021-06-12").cast("date").alias("day"))
    logs = sinks.write_page_table(base.withColumn("status", F.lit("ok")), "pagetide_logs", ["page_key", "day"], 4)
    pages = sinks.write_page_table(base.withColumn("html", F.lit("<html>")), "pagetide_pages", ["page_key", "day"], 4)
    try:
        joined = logs.hint("merge").join(pages, ["page_key", "day"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.count() == 500
        assert "Exchange" not in pages.groupBy("page_key", "day").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP TABLE pagetide_logs")
        spark.sql("DROP TABLE pagetide_pages")

"""Crawl-log / page-file readers, the whole clean-up job, sinks and checkpoints."""
import os

from pyspark.sql import functions as F

from pagetide.operators import crawl as C
from pagetide.sources import sinks

HEADER = "Stage file,URL index,Status code,Timestamp,File present,URL\n"


def _page(body):
    return f"<html><body><p>{body}</p></body></html>"


def _write_crawl(root):
    day = os.path.join(root, "20210612-run")
    os.makedirs(os.path.join(day, "pages"))
    logs = {
        0: [("links_s00", 1, "RequestStatus.HEADLESS_SUCCESS", "True", "http://a.nl", _page("one<p>two<p>three<p>four")),
            ("links_s00", 2, "RequestStatus.HEADLESS_SUCCESS", "True", "http://b.nl", _page("one<p>two<p>three<p>x")),
            ("links_s00", 3, "RequestStatus.TIMEOUT", "True", "http://c.nl", _page("gone")),
            ("links_s01", 1, "RequestStatus.HEADLESS_SUCCESS", "True", "http://d.nl", _page("fresh<p>text")),
            ("links_s01", 2, "RequestStatus.HEADLESS_SUCCESS", "False", "http://e.nl", None)],
        1: [("links_s00", 4, "RequestStatus.HEADLESS_SUCCESS", "True", "http://f.nl", _page("other")),
            ("links_s00", 5, "RequestStatus.HEADLESS_SUCCESS", "True", "http://g.nl", b"\xff\xfe<html>bad")],
    }
    for k, rows in logs.items():
        with open(os.path.join(day, f"log-thread-{k}.csv"), "w") as f:
            f.write(HEADER)
            for stage, idx, status, present, url, page in rows:
                f.write(f"{stage},{idx},{status},20210612101500,{present},{url}\n")
                if page is not None:
                    mode = "wb" if isinstance(page, bytes) else "w"
                    with open(os.path.join(day, "pages", f"{stage}-{idx}"), mode) as p:
                        p.write(page)
    return day


def test_clean_crawl_end_to_end(spark, tmp_path):
    day = _write_crawl(str(tmp_path))
    logs = C.read_crawl_logs(spark, os.path.join(str(tmp_path), "*", "*.csv"))
    first = logs.filter("page_key = 'links_s01-1'").first()
    assert (first["log_index"], first["stage_index"], first["url_index"], str(first["day"])) == (0, 1, 1, "2021-06-12")
    blobs = C.read_page_blobs(spark, os.path.join(day, "pages"))
    assert blobs.filter("page_key = 'links_s00-5'").first()["html"] == ""
    clean = C.clean_crawl(logs, blobs)
    kept = sorted(r["page_key"] for r in clean.collect())
    # s00-2 repeats the first three lines of s00-1; s00-3 failed; s01-2 has no file; s00-5 is not UTF-8 (no text)
    assert kept == ["links_s00-1", "links_s00-4", "links_s01-1"]


def test_sample_and_order_index(spark):
    df = spark.createDataFrame([(1, 2, i) for i in (41, 42, 142, 300)], "log_index int, stage_index int, url_index int")
    assert [r["url_index"] for r in C.sample_crawl(df).collect()] == [42, 142]
    assert C.with_order_index(df).first()["order_index"] == 1_002_000_041


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "http://a.nl"), (1, "http://b.nl"), (1, "http://c.nl")], "stage int, link string")
    out = str(tmp_path / "stages")
    sinks.write_stage_files(df, out)
    assert sorted(x for x in os.listdir(out) if x.startswith("stage=")) == ["stage=links_s00", "stage=links_s01"]
    back = sinks.save_checkpoint(df, "roundtrip", root=str(tmp_path / "ckpt"))
    assert back.count() == 3
    csv = str(tmp_path / "csv")
    sinks.write_csv(df.withColumn("b", F.lit(1)), csv, lead=["link"])
    assert spark.read.option("header", True).csv(csv).columns == ["link", "b", "stage"]


def test_two_crawl_days_to_change_bits(spark, tmp_path):
    from pagetide.operators import diff as D
    rows = {"20210612": {"links_s00-1": _page("same") + "", "links_s00-2": _page('a <a href="/x">x</a>')},
            "20210613": {"links_s00-1": _page("same"), "links_s00-2": _page('b <a href="/y">y</a>')}}
    for day, pages in rows.items():
        d = os.path.join(str(tmp_path), f"{day}-run")
        os.makedirs(os.path.join(d, "pages"))
        with open(os.path.join(d, "log-thread-0.csv"), "w") as f:
            f.write(HEADER)
            for key, page in pages.items():
                stage, idx = key.rsplit("-", 1)
                f.write(f"{stage},{idx},RequestStatus.HEADLESS_SUCCESS,{day}101500,True,http://www.site.nl/p{idx}\n")
                with open(os.path.join(d, "pages", key), "w") as p:
                    p.write(page)
    logs = C.read_crawl_logs(spark, os.path.join(str(tmp_path), "*", "*.csv"))
    blobs = C.read_page_blobs(spark, os.path.join(str(tmp_path), "*", "pages"))
    bits = {r["page_id"]: (r["text_changed"], r["internal_outlinks_changed"], r["external_outlinks_changed"])
            for r in D.crawl_change_bits(C.clean_crawl(logs, blobs)).collect()}
    assert bits == {"links_s00-1": (0, 0, 0), "links_s00-2": (1, 1, 0)}


def test_feature_csvs_parquet_days_and_preview(spark, tmp_path):
    df = spark.createDataFrame([("links_s00", 2, ["b"], "2021-06-12"), ("links_s00", 1, ["a", "c"], "2021-06-13")],
                               "stage_file string, url_index int, text array<string>, day string")
    sinks.write_feature_csvs(df, str(tmp_path / "features"), ["text"])
    back = spark.read.option("header", True).csv(str(tmp_path / "features" / "text"))
    assert sorted(r["url_index"] for r in back.collect()) == ["1", "2"]
    sinks.write_parquet(df, str(tmp_path / "days"), partition_by=["day"])
    assert sorted(os.listdir(tmp_path / "days"))[-2:] == ["day=2021-06-12", "day=2021-06-13"]
    pv = sinks.preview(df, "url_index", "text", n=1)
    assert pv["count"] == 2 and len(pv["sample"]) == 1 and len(pv["sample"][0]["md5"]) == 32

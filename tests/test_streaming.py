"""Streaming change bits equal the batch operator once all days have arrived."""
import uuid

from pyspark.sql import functions as F

from pagetide.operators import diff as D
from pagetide.sources import proxies as X
from pagetide.sources.tables import Tables
from pagetide.streaming.change_stream import change_bits_stream, read_bits

from conftest import SF_SMALL

FEATURES = ["text", "internal_outlinks", "meta"]


def test_stream_matches_batch(spark, tmp_path):
    snap = (X.snapshots(Tables(spark, SF_SMALL).documents)
              .select(F.col("page_id").cast("string").alias("page_id"),
                      F.date_add(F.lit("2021-06-12").cast("date"), F.col("day_no")).alias("day"), *FEATURES))
    src, sink = str(tmp_path / "features"), str(tmp_path / "bits")
    name = f"t{uuid.uuid4().hex[:8]}"
    for day in ("2021-06-12", "2021-06-13"):
        snap.filter(F.col("day") == day).write.mode("append").partitionBy("day").parquet(src)
        q = change_bits_stream(spark, src, snap.schema, FEATURES, sink, name=name)
        q.awaitTermination(300)
    got = read_bits(spark, sink).select("page_id", *[f + "_changed" for f in FEATURES])
    want = D.change_bits(snap, FEATURES).select("page_id", *[f + "_changed" for f in FEATURES])
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_follows_the_calendar_and_pairs_late_rows(spark, tmp_path):
    import datetime as dt
    days = [dt.date(2021, 6, 12), dt.date(2021, 6, 13), dt.date(2021, 6, 15)]
    rows = [("p", days[0], ["a"]), ("p", days[1], ["b"]), ("p", days[2], ["b"]), ("q", days[0], ["x"]), ("q", days[2], ["x"]),
            ("late", days[2], ["z"]), ("late", days[0], ["y"]), ("late", days[1], ["y"])]
    snap = spark.createDataFrame(rows, "page_id string, day date, text array<string>")
    src, sink, name = str(tmp_path / "features"), str(tmp_path / "bits"), f"t{uuid.uuid4().hex[:8]}"
    arrivals = [snap.where(~F.col("page_id").eqNullSafe("late") & (F.col("day") == days[0])),
                snap.where("day = '2021-06-13' AND page_id <> 'late' OR day = '2021-06-15'"),
                snap.where("page_id = 'late' AND day <> '2021-06-15'")]
    for some in arrivals:
        some.write.mode("append").parquet(src)
        change_bits_stream(spark, src, snap.schema, ["text"], sink, name=name, days=days).awaitTermination(300)
    got = sorted(tuple(r) for r in read_bits(spark, sink).select("page_id", "day1", "day2", "text_changed").collect())
    want = sorted(tuple(r) for r in D.change_bits(snap, ["text"], days=days).select("page_id", "day1", "day2", "text_changed").collect())
    assert got == want and len(got) == 4


def test_stream_keeps_its_state_in_native_operators(spark, tmp_path):
    import datetime as dt
    days = [dt.date(2021, 6, 12), dt.date(2021, 6, 13)]
    rows = [("p", days[0], ["a"]), ("p", days[0], ["a"]), ("p", days[1], None), (None, days[0], ["n"]), (None, days[1], ["n"])]
    spark.createDataFrame(rows, "page_id string, day date, text array<string>").write.parquet(str(tmp_path / "features"))
    schema = spark.read.parquet(str(tmp_path / "features")).schema
    q = change_bits_stream(spark, str(tmp_path / "features"), schema, ["text"], str(tmp_path / "bits"), name=f"t{uuid.uuid4().hex[:8]}")
    q.awaitTermination(300)
    got = [(r["page_id"], r["text_changed"]) for r in read_bits(spark, str(tmp_path / "bits")).collect()]
    assert sorted(got, key=str) == [("p", 1), (None, 0)]
    assert {o["operatorName"] for o in q.recentProgress[0]["stateOperators"]} == {"dedupe", "symmetricHashJoin"}

"""Threat list and its time window."""

from __future__ import annotations

import datetime as dt

from pagetide.operators import threats as TH


def test_threat_list_and_window(spark, tmp_path):
    (tmp_path / "threats.csv").write_text("Id,Occured on\n1,14-06-2021 10:00:00\n2,\n3,14-06-2021 10:00:05\n")
    threats = TH.read_threats(spark, str(tmp_path / "threats.csv"))
    times = [(1, "09:59:59.999"), (2, "10:00:00.000"), (3, "10:00:15.900"), (4, "10:00:16.000"), (5, "10:00:07.250")]
    logs = spark.createDataFrame([(i, f"2021-06-14 {t}") for i, t in times] + [(6, None)], "id int, s string")
    logs = logs.selectExpr("id", "to_timestamp_ntz(s) AS ts")
    found = TH.flag_threat_window(logs, threats, seconds=10)
    assert sorted(r["id"] for r in found.collect()) == [2, 3, 5]
    assert found.columns == ["id", "ts"]
    assert {r["id"]: r["ts"] for r in found.collect()}[5] == dt.datetime(2021, 6, 14, 10, 0, 7, 250000)


def test_window_of_hours_against_brute_force(spark):
    import random
    r = random.Random(8)
    start = dt.datetime(2021, 6, 14)
    threats = [start + dt.timedelta(seconds=r.randint(-200_000, 200_000)) for _ in range(25)] + [dt.datetime(1969, 12, 31, 20)]
    logs = [(i, start + dt.timedelta(seconds=r.randint(-250_000, 250_000), microseconds=r.randint(0, 999_999))) for i in range(800)]
    logs += [(900, dt.datetime(1969, 12, 31, 23, 59, 59)), (901, None)]
    log_rows = spark.createDataFrame(logs, "id int, ts timestamp_ntz")
    threat_rows = spark.createDataFrame([(t,) for t in threats] * 2 + [(None,)], "ts timestamp_ntz")
    for seconds in (0, 1, 3 * 3600):
        found = sorted(x["id"] for x in TH.flag_threat_window(log_rows, threat_rows, seconds=seconds).collect())
        want = sorted(i for i, t in logs if t is not None and any(0 <= (t.replace(microsecond=0) - h).total_seconds() <= seconds for h in threats))
        assert found == want and (seconds < 10 or len(found) > 50)
    plan = TH.flag_threat_window(log_rows, threat_rows, seconds=3600)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "sequence" not in plan

"""Order statistics against brute force; interval and confusion cases."""
import random

from pyspark.sql import functions as F

from pagetide.operators import stats as ST


def _values():
    rnd = random.Random(3)
    return {"a": [rnd.randint(0, 40) for _ in range(501)], "b": [rnd.randint(-5, 5) for _ in range(64)]}


def _long(spark, vals):
    return spark.createDataFrame([(f, v) for f, vs in vals.items() for v in vs], "feature string, value int")


def test_percentiles_brute_force(spark):
    vals = _values()
    got = {(r["feature"], r["percentile"]): r["value"] for r in ST.percentiles(_long(spark, vals)).collect()}
    for f, vs in vals.items():
        s = sorted(vs)
        for p in (0, 20, 40, 60, 80, 100):
            assert got[(f, p)] == s[int((len(s) - 1) * p / 100)]


def test_value_statistics_brute_force(spark):
    vals = _values()
    got = {r["feature"]: r for r in ST.value_statistics(_long(spark, vals), 0.025).collect()}
    for f, vs in vals.items():
        s, n = sorted(vs), len(vs)
        t = int(n * 0.025)
        kept = s[t:n - t]
        assert got[f]["min"] == s[t] and got[f]["max"] == s[n - 1 - t]
        assert abs(got[f]["avg"] - sum(kept) / len(kept)) < 1e-9
        med = int((s[n // 2 - 1] + s[n // 2]) / 2) if n % 2 == 0 else s[n // 2]
        assert got[f]["med"] == med


def test_interval_edges_brute_force(spark):
    vals = _values()
    got = {(r["feature"], r["interval"]): (r["start"], r["end"]) for r in ST.interval_edges(_long(spark, vals), 10).collect()}
    for f, vs in vals.items():
        s = sorted(vs)
        idx = [int((len(s) - 1) / 10 * i) for i in range(11)]
        edges = [s[i] for i in idx]
        edges[-1] += 1
        for i in range(10):
            assert got[(f, i)] == (edges[i], edges[i + 1])


def test_zero_width_intervals_match_several(spark):
    iv = spark.createDataFrame([("f", 0, 0, 0), ("f", 1, 0, 0), ("f", 2, 0, 1), ("f", 3, 1, 2), ("f", 4, 2, 648)],
                               "feature string, interval int, start int, end int")
    long = spark.createDataFrame([("f", 0), ("f", 1), ("f", 5)], "feature string, value int")
    hits = {(r["value"], r["interval"]) for r in ST.interval_join(long, iv).collect()}
    assert hits == {(0, 0), (0, 1), (0, 2), (1, 3), (5, 4)}


def test_minimum_recall(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 3 + [(1, 0)] * 2 + [(1, 1)] * 7
    df = spark.createDataFrame(rows, "label int, prediction int")
    r = ST.confusion(df).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (5, 3, 2, 7)
    assert abs(r["min_recall"] - 0.625) < 1e-12 and abs(r["recall_one"] - 7 / 9) < 1e-12


def test_feature_grid_axes(spark):
    import numpy as np
    st = spark.createDataFrame([(2, 792, 6, 2186)], "xl int, xh int, yl int, yh int")
    g = ST.feature_grid(st, "xl", "xh", "yl", "yh", 100)
    xs = sorted({r["x"] for r in g.select("x").distinct().collect()})
    assert xs == sorted(set(np.linspace(2, 792, 100, dtype=int).tolist()))
    assert g.count() == len(xs) * len(set(np.linspace(6, 2186, 100, dtype=int).tolist()))

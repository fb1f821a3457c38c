"""Previous rows and running totals across range partitions, against windows and loops."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagetide.operators import stats as ST
from pagetide.operators.ordering import running_total, with_previous


def _rows(n, seed=1):
    r = random.Random(seed)
    return [(None if r.random() < 0.1 else "hot" if r.random() < 0.6 else f"g{r.randint(0, 9)}", i, [str(r.randint(0, 5))] * r.randint(0, 2) or None)
            for i in r.sample(range(10 * n), n)]


def test_previous_row_equals_lag(spark):
    df = spark.createDataFrame(_rows(3000), "g string, x int, v array<string>")
    want = {(r["g"], r["x"]): (r["p"], r["q"]) for r in df.select(
        "g", "x", F.lag("v").over(Window.partitionBy("g").orderBy("x")).alias("p"), F.lag("x").over(Window.partitionBy("g").orderBy("x")).alias("q")).collect()}
    for partitions in (1, 7, 64):
        got = with_previous(df.repartition(5), ["g"], ["x"], ["v", "x"], {"p": F.col("prev_v"), "q": F.col("prev_x"), "has": F.col("has_prev")}, ["g", "x"],
                            num_partitions=partitions).collect()
        assert len(got) == 3000 and {(r["g"], r["x"]): (r["p"], r["q"]) for r in got} == want
        assert all(r["has"] == (r["q"] is not None) for r in got)


def test_previous_row_without_groups_and_with_more_partitions_than_rows(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "x int, v string")
    got = with_previous(df, [], ["x"], ["v"], {"p": F.col("prev_v")}, ["x"], num_partitions=50)
    assert {r["x"]: r["p"] for r in got.collect()} == {i: f"t{i - 1}" if i else None for i in range(20)}
    assert with_previous(df.limit(0), [], ["x"], ["v"], {"p": F.col("prev_v")}, ["x"]).collect() == []


def test_running_total(spark):
    rows = [(f"f{i % 3}", i * 7 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "f string, v int, w long")
    for partitions in (1, 16):
        got = {(r["f"], r["v"]): r["running"] for r in running_total(df, ["f", F.col("v").desc()], "w", num_partitions=partitions).collect()}
        total = 0
        for f, v, w in sorted(rows, key=lambda r: (r[0], -r[1])):
            total += w
            assert got[(f, v)] == total
    assert running_total(df.limit(0), ["f"], "w").collect() == []


def test_histogram_of_many_values_in_one_feature(spark):
    r = random.Random(2)
    vals = {"hot": [r.randint(0, 3000) for _ in range(6000)], "b": [5] * 40, "c": [None, 1, 2]}
    long = spark.createDataFrame([(f, v) for f, vs in vals.items() for v in vs], "feature string, value int")
    for row in ST.histogram(long).collect():
        ordered = sorted(v for v in vals[row["feature"]] if v is not None)
        assert ordered[row["lo"]] == ordered[row["hi"]] == row["value"] and row["hi"] - row["lo"] + 1 == row["cnt"] and row["n"] == len(ordered)
        assert row["hi"] == row["n"] - 1 or ordered[row["hi"] + 1] > row["value"]


def test_rank_curve_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ST, "RANK_BLOCK", 7)
    vals = [3] * 50 + [9] * 2 + [1]
    long = spark.createDataFrame([("a", v) for v in vals], "feature string, value int")
    got = sorted((r["position"], r["value"], r["percentile"]) for r in ST.rank_curve(ST.histogram(long, descending=True), ["feature"], "value").collect())
    want = sorted(vals, reverse=True)
    assert [(p, v) for p, v, _ in got] == list(enumerate(want, 1))
    assert [x for *_, x in got] == [i * 100.0 / 52 for i in range(53)]

"""Nothing is lost to null groups, null days or missing lists; samples do not depend on partitions."""
from pyspark.sql import functions as F

from pagetide.operators import diff as D
from pagetide.operators.ml import balance_by_sampling
from pagetide.operators.ordering import dense_index, previous_row


def test_null_groups_are_numbered(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 3)], "g string, x int")
    indexed = dense_index(df, ["g"], ["x"], total="n")
    got = sorted((str(r["g"]), r["x"], r["idx"], r["n"]) for r in indexed.collect())
    assert got == [("None", 1, 1, 2), ("None", 2, 2, 2), ("a", 1, 1, 2), ("a", 3, 2, 2)]
    prev = {(r["g"], r["x"]): r["prev_x"] for r in previous_row(indexed, ["g"], "idx", ["x"]).collect()}
    assert prev == {(None, 1): None, (None, 2): 1, ("a", 1): None, ("a", 3): 1}


def test_missing_lists_count_as_empty(spark):
    cases = [(0, None, ["a"]), (1, ["a", "b"], None), (2, None, None), (3, ["a"], ["a", "c"])]
    df = spark.createDataFrame(cases, "i int, a array<string>, b array<string>")
    got = {r["i"]: tuple(r["o"]) for r in df.select("i", D.opcode_struct(F.col("a"), F.col("b")).alias("o")).collect()}
    assert got == {0: (0, 1, 0), 1: (0, 0, 2), 2: (0, 0, 0), 3: (1, 1, 0)}
    snaps = spark.createDataFrame([("p", 1, None), ("p", 2, ["x"]), ("p", 3, None), ("p", 4, None)], "page_id string, day int, f array<string>")
    bits = {r["day2"]: r["f_changed"] for r in D.change_bits(snaps, ["f"]).collect()}
    assert bits == {2: 1, 3: 1, 4: 0}


def test_balanced_sample_is_the_same_in_any_partitioning(spark):
    df = spark.range(2000).select(F.col("id").alias("page_id"), (F.col("id") % 5 == 0).cast("double").alias("label"))
    samples = [sorted(r[0] for r in balance_by_sampling(df.repartition(n)).select("page_id").collect()) for n in (1, 3, 8)]
    assert samples[0] == samples[1] == samples[2]
    n1 = sum(i % 5 == 0 for i in samples[0])
    assert n1 == 400 and abs(len(samples[0]) - n1 - 400) < 80

"""Spreadsheet exports, positional training CSVs, part-file directories, log pairs, model IO."""
import os

import pytest
from pyspark.sql import functions as F

from pagetide.operators import crawl as C
from pagetide.operators import ml as M
from pagetide.sources import files as FS


def test_excel_export(spark, tmp_path):
    p = tmp_path / "labels.csv"
    p.write_bytes("﻿Page;Categories\ns00-1;News headline,Other\ns00-2;Typo\x00fix\n".encode("utf-8"))
    df = FS.read_excel_csv(spark, str(p))
    assert df.columns == ["Page", "Categories"]
    assert sorted(r["Categories"] for r in df.collect()) == ["News headline,Other", "Typofix"]


def test_training_pairs_and_parts(spark, tmp_path):
    for d in ("a", "b"):
        os.makedirs(tmp_path / d)
        (tmp_path / d / "part-00000").write_text(f"{d}_s00-1,1,2,3,4,5,6,7,8,9,1,0,0\n")
        (tmp_path / d / "_SUCCESS").write_text("")
    schema = FS.read_training_pairs(spark, str(tmp_path / "a")).schema
    df = FS.combine_part_files(spark, str(tmp_path), schema=schema)
    assert df.count() == 2 and df.first()["html_tags"] == 9
    bits = spark.createDataFrame([("links_s00-3", "20210612", "20210613", 1, 0, 1)],
                                 "file_name string, day1 string, day2 string, text int, ilinks int, elinks int")
    assert FS.shorten_change_rows(bits).columns == ["page_id", "day2", "text", "ilinks", "elinks"]
    assert FS.shorten_change_rows(bits).first()["page_id"] == "s00-3"


def test_log_entry_pairs(spark):
    a = spark.createDataFrame([("links_s00", 1, "x"), ("links_s00", 2, "y")], "stage_file string, url_index int, v string")
    b = spark.createDataFrame([("links_s00", 2, "z")], "stage_file string, url_index int, v string")
    r = C.log_entry_pairs(a, b).collect()
    assert len(r) == 1 and (r[0]["v-1"], r[0]["v-2"]) == ("y", "z")


def test_model_round_trip(spark, tmp_path):
    rows = [(str(i), i % 7, (i * 3) % 11, int(i % 7 > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id string, a int, b int, label int")
    train, test, balanced, _ = M.prepare(df, ["a", "b"])
    model = M.random_forest(balanced, 10, 5, 1)
    M.save_model(model, str(tmp_path / "rf"))
    again = M.load_model("rf", str(tmp_path / "rf"))
    p1 = model.transform(test).select("prediction").collect()
    p2 = again.transform(test).select("prediction").collect()
    assert p1 == p2
    assert abs(test.count() / df.count() - 0.2) < 0.1
    assert test.join(train, "page_id").count() == 0
    counts = {r["label"]: r["count"] for r in balanced.groupBy("label").count().collect()}
    assert abs(counts[0.0] - counts[1.0]) <= 0.35 * max(counts.values())


def test_command_line_runs_a_query(spark, tmp_path):
    from pagetide.__main__ import main
    from conftest import SF_SMALL
    out = str(tmp_path / "linkage")
    assert main(["page_linkage", SF_SMALL, out]) == 0
    assert spark.read.parquet(out).count() == 50


def test_regression_cross_validation(spark):
    rows = [(str(i), i % 7, (i * 3) % 11, int(i % 7 > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id string, a int, b int, label int")
    train, test, balanced, _ = M.prepare(df, ["a", "b"])
    cv = M.cross_validated_regression(balanced, families=("binomial",), elastic_net=(0.0,), reg=(0.01, 1.0), folds=2)
    assert len(cv.avgMetrics) == 2 and cv.bestModel.getOrDefault("regParam") in (0.01, 1.0)


def test_training_rows_have_a_partition_a_core_at_most(spark):
    rows = [(str(i % 90), i % 7, (i * 3) % 11, int(i % 7 > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id string, a int, b int, label int")
    cores = spark.sparkContext.defaultParallelism
    dealt = []
    for n in (5 * cores, 7 * cores):
        prep = M.prepare(df.repartition(n), ["a", "b"])
        assert prep.balanced.rdd.getNumPartitions() <= cores
        held = prep.source.select("page_id", "a", "b", "label", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
        dealt.append(sorted(map(tuple, held.collect())))
        prep.release()
    assert dealt[0] == dealt[1] and sorted(r[:4] for r in dealt[0]) == sorted(rows)
    few = df.coalesce(1)  # no more partitions than cores: left as they are
    assert M.prepare(few, ["a", "b"]).source.rdd.getNumPartitions() == 1


def test_forest_cross_validation_as_by_cross_validator(spark, monkeypatch):
    import threading

    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    rows = [(str(i), i % 7, (i * 3) % 11, int(i * 7919 % 13 > 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id string, a int, b int, label int").coalesce(2)
    balanced = M.prepare(df, ["a", "b"]).balanced
    rf = RandomForestClassifier(seed=M.SEED)
    grid = ParamGridBuilder().addGrid(rf.numTrees, [3]).addGrid(rf.maxDepth, [2, 4]).addGrid(rf.minInstancesPerNode, [1]).build()
    one = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=3, seed=M.SEED).fit(balanced)
    lock, running, most, fit = threading.Lock(), [], [], RandomForestClassifier.fit

    def counted(self, *args):
        with lock:
            running.append(1)
            most.append(len(running))
        try:
            return fit(self, *args)
        finally:
            with lock:
                running.pop()

    monkeypatch.setattr(RandomForestClassifier, "fit", counted)
    two = M.cross_validated_forest(balanced, num_trees=(3,), max_depth=(2, 4), min_instances=(1,), folds=3)
    assert one.avgMetrics == pytest.approx(two.avgMetrics, abs=1e-12) and one.stdMetrics == pytest.approx(two.stdMetrics, abs=1e-12)
    assert one.bestModel.toDebugString.split("\n", 1)[1] == two.bestModel.toDebugString.split("\n", 1)[1]
    assert len(most) == 3 * 2 + 1 and max(most) > 2  # all folds and cells at once, then the best cell


def test_command_line_lists_queries(capsys):
    from pagetide.__main__ import main
    assert main(["--list"]) == 0
    names = capsys.readouterr().out.split()
    from pagetide.plans.catalog import QUERIES
    assert {"page_linkage", "streamed_pair_bits", "lr_pairs"} <= set(names) and set(QUERIES) <= set(names)


def test_pca_model_round_trip(spark, tmp_path):
    from pagetide.operators import vectors as V
    rows = [(i, [float(i % 5), float(i % 3), float(i)]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    model = V.fit_pca(df, "embedding", 2)
    M.save_model(model, str(tmp_path / "pca"))
    again = M.load_model("pca", str(tmp_path / "pca"))
    one, two = ({r["vec_id"]: r["pca"] for r in V.project_pca(m, df, "vec_id", "embedding").collect()} for m in (model, again))
    assert one == two and one[99] is None and len(one[0]) == 2 and abs(sum(v[0] for v in one.values() if v)) < 1e-6
    parts = V.pca_components(again, spark).collect()
    assert [len(r["loadings"]) for r in parts] == [3, 3] and parts[0]["explained"] >= parts[1]["explained"]


def test_fits_side_by_side_equal_serial_fits(spark):
    rows = [(str(i), i % 7, (i * 3) % 11, i % 4, int(i % 7 > 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id string, a int, b int, c int, label int")
    train, test, balanced, _ = M.prepare(df, ["a", "b", "c"])
    found = [(pair, model.coefficients.toArray().tolist(), conf) for pair, model, conf in M.pair_models(balanced, test, ["a", "b", "c"], fit=M.logistic_regression)]
    assert [pair for pair, *_ in found] == [(0, 1), (0, 2), (1, 2)]
    for (a, b), weights, conf in found:
        model = M.logistic_regression(M.select_subset(balanced, ["a", "b", "c"], [a, b]))
        assert model.coefficients.toArray().tolist() == weights
        assert M.evaluate(model, M.select_subset(test, ["a", "b", "c"], [a, b])).first().asDict() == conf


def test_submitted_script_from_another_folder_finds_the_package(tmp_path):
    """A query with a Python helper, run by spark-submit outside the repository."""
    import subprocess
    import sys

    import pyspark
    from conftest import ROOT, SF_SMALL
    submit = os.path.join(os.path.dirname(pyspark.__file__), "bin", "spark-submit")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([submit, "--master", "local[2]", "--conf", "spark.ui.enabled=false", "--conf", f"spark.checkpoint.dir={tmp_path}/ckpt",
                           "--conf", "spark.sql.shuffle.partitions=4", f"{ROOT}/pagetide/__main__.py", "diff_totals", SF_SMALL, str(tmp_path / "out")],
                          cwd=tmp_path, env={**env, "PYSPARK_PYTHON": sys.executable, "PYSPARK_DRIVER_PYTHON": sys.executable}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet")]

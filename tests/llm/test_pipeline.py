"""The pipeline's stages on a small table, the registered queries' shapes and their SQL."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagetide.llm.oracle import ORACLE
from pagetide.llm.queries import QUERIES
from pagetide.plans.check import compare, duckdb_connection

SMALL = "/root/testdata/sf0.001"


def test_ten_operators_are_registered():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    ok, message = compare(QUERIES[name](spark, SMALL), duckdb_connection(SMALL), ORACLE[name], digits=9)
    assert ok, message


def test_stages_hand_on_documents(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, "one two three the of and", None, None, None), (900001, None, "en", "src0", 0), (900002, "", "en", "src1", 0)], given.schema)
    docs = given.unionByName(odd).withColumn("score", F.lit("x"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        folder = corpus_pipeline.shared_folder(spark, name)
        stage(spark, docs, SMALL).write.parquet(folder)
        after = spark.read.parquet(folder)
        if name != "encoding":
            assert after.columns == docs.columns, name
        sizes.append(after.count())
        if name == "language":
            assert after.where("doc_id IN (900001, 900002)").count() == 0
            assert sizes[-1] >= given.count() * 0.98  # clean documents stay
        if name == "near_duplicates":
            assert after.groupBy("doc_id").count().where("count > 1").count() == 0
        if name == "repeated_passages":
            assert after.where("n_chars <> length(text)").join(given, ["doc_id", "text"], "left_anti").count() == 0
        docs = after
    assert sizes[1] < sizes[0] and docs.where("n_tokens <> size(ids)").count() == 0


def test_without_labels_only_texts_without_letters_go(spark):
    rows = [(i, t, None, "s", 3) for i, t in enumerate(["one two", "слово", None, "", "12 !?", "x"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    ids = lambda df: sorted(r["doc_id"] for r in corpus_pipeline.language(spark, df, SMALL).collect())
    assert ids(spark.createDataFrame(rows, schema)) == [0, 1, 5]
    numbers = spark.range(40).select(F.col("id").alias("doc_id"))
    held = [r["doc_id"] for r in numbers.where(corpus_pipeline.langid.held_out(F.col("doc_id"))).collect()]
    assert held and ids(spark.createDataFrame([(i, "held out", "en", "s", 8) for i in held], schema)) == held


@pytest.mark.parametrize("family, margin, kept", [(0.7, 0.55, 1), (0.39, 0.99, 0), (0.99, 0.39, 0)])
def test_family_and_margin_are_judged_apart(spark, monkeypatch, family, margin, kept):
    langid = corpus_pipeline.langid
    none = np.zeros(langid.DIMS)
    # Two families beside the winner; inside it, a language that wins every vote, or three with a vote each.
    bias = np.log(np.array([family, (1 - family) / 2, (1 - family) / 2]))
    pair = (none, float(-np.log(1 / margin - 1) / 4))
    model = langid.Model(["germanic", "romance", "slavic"], {"germanic": ["de", "en", "nl"]}, np.zeros((3, langid.DIMS)), bias,
                         {("de", "en"): (none, 9.0), ("de", "nl"): pair, ("en", "nl"): (none, 9.0)})
    assert model.predict(none) == ("de", pytest.approx(family), pytest.approx(margin))
    monkeypatch.setattr(langid, "train", lambda *a: model)
    docs = spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language(spark, docs, SMALL).count() == kept


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        folder = corpus_pipeline.shared_folder(spark, name)
        stage(spark, docs, SMALL).write.parquet(folder)
        docs = spark.read.parquet(folder)
        assert docs.count() == 0

"""What the crawl operators work out once, and the patterns written for Java."""
import pyarrow as pa
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.operators import crawl as C
from pagetide.operators.ordering import with_previous
from pagetide.sources import tables


def test_clean_pages_are_read_back_not_joined_again(spark, tmp_path):
    rows = [("2021-06-12", f"k{i}", 0, 0, i, C.SUCCESS_STATUS, True, f"<html><p>text {i}</p></html>") for i in range(4)]
    rows.append(("2021-06-12", "k4", 0, 0, 4, C.SUCCESS_STATUS, True, "<html><p>text 3</p></html>"))
    spark.createDataFrame(rows, "day string, page_key string, log_index int, stage_index int, url_index int, status string, file_present boolean, html string") \
         .write.parquet(str(tmp_path / "s"))
    series = spark.read.parquet(str(tmp_path / "s"))
    clean = C.clean_crawl(series.drop("html"), series.select("day", "page_key", "html"), use_ratio=False)
    assert sorted((r["page_key"], r["text_lines"]) for r in clean.collect()) == [(f"k{i}", [f"text {i}"]) for i in range(4)]
    assert not any(str(tmp_path) in name for name in clean.inputFiles())


def test_signatures_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays(batch.columns, names=["id"])

    df = spark.range(100).repartition(4).mapInArrow(counted, "id long")
    out = with_previous(df, [], ["id"], ["id"], {"before": F.col("prev_id")}, ["id"])
    assert sorted((r["id"], r["before"]) for r in out.collect()) == [(i, i - 1 if i else None) for i in range(100)]
    assert seen.value == 100


def test_large_text_tables_get_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id AS page_id", "'u' AS url", "sha2(string(id), 512) AS html").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert tables.Tables(spark, str(tmp_path)).pages.rdd.getNumPartitions() == cores
    monkeypatch.setattr(tables, "TASK_BYTES", 1 << 10)
    monkeypatch.setattr(tables, "TASKS_PER_CORE", 3)
    pages = tables.Tables(spark, str(tmp_path)).pages
    assert pages.rdd.getNumPartitions() == 3 * cores and pages.count() == 2000


def test_literal_replacement(spark):
    texts = ["", None, "a.b a.b", "$1 \\ x", "ab" * 5, "é.b€"]
    for find, new in (("a.b", "$1"), ("ab", "\\"), (".b", ""), ("$1", "é$")):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(H.replaced("t", find, new), F.replace("t", F.lit(find), F.lit(new)))
        assert all(r[0] == r[1] for r in df.collect())


def test_patterns_for_java_match_what_the_shared_ones_match(spark):
    texts = ["<ScRipt a>x</SCRIPT  ><style>y</style >z", "<script>1</style>2</script>3<SCRIPTS>4</script>", "<stıyle>", "<ſcript>a</script>",
             "<HEAD x><p></Head >b<head>", "<header>h</header>", "<A HREF=x>1</a><a\nclass=b hReF = 'y z'>2<a data-href=\"q\">", "a<A href=>", "<", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for key, shared in (("script_style", H.SCRIPT_STYLE_RE), ("head", H.HEAD_RE), ("href", H.HREF_RE)):
        group = 1 if key == "href" else 0
        got = df.select(F.regexp_extract_all("t", F.lit(H._ANY_CASE[key]), group), F.regexp_extract_all("t", F.lit(shared), group)).collect()
        assert all(r[0] == r[1] for r in got) and any(r[0] for r in got)
    got = df.select(H.script_bodies_out("t"), F.regexp_replace("t", H.SCRIPT_STYLE_BODY_RE, "$1$2$3$4")).collect()
    assert all(r[0] == r[1] for r in got)

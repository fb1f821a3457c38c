"""List alignment exactness, diff identities and the false-duplicate rules."""
import difflib
import random

from pyspark.sql import functions as F

import difflib


def opcode_counts_py(a, b):
    """(equal, insert, delete) from the edit operations themselves."""
    sizes = {"equal": 0, "insert": 0, "delete": 0}
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a or [], b or []).get_opcodes():
        if tag == "equal":
            sizes["equal"] += i2 - i1
        else:
            sizes["delete"] += i2 - i1
            sizes["insert"] += j2 - j1
    return tuple(sizes.values())
from pagetide.operators import crawl as C
from pagetide.operators import diff as D
from pagetide.operators.ordering import dense_index


def _cases():
    rnd = random.Random(7)
    cases = [([], []), (["a"], []), ([], ["b"]), (["a", "b"], ["a", "b"]), (["a", "b", "c"], ["a", "x", "c"]),
             (["p"] * 150 + ["q", "r"] * 40, ["p"] * 120 + ["s"] + ["q", "r"] * 41),
             (["z", "b", "c", "x"], ["a", "b", "c", "x"])]
    for _ in range(40):
        a = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 30))]
        cases.append((a, b))
    return cases


def test_opcodes_match_difflib(spark):
    cases = _cases()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = {r["i"]: (r["o"]["equal"], r["o"]["insert"], r["o"]["delete"])
           for r in df.select("i", D.opcode_struct(F.col("a"), F.col("b")).alias("o")).collect()}
    for i, (a, b) in enumerate(cases):
        assert got[i] == opcode_counts_py(a, b), (a, b)
        e, ins, dele = got[i]
        assert e + dele == len(a) and e + ins == len(b)


def test_overlap_ratio_matches_difflib(spark):
    from pagetide.functions.udfs import matched_elements
    cases = _cases()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["r"] for r in df.select("i", F.coalesce(F.try_divide(2.0 * matched_elements("a", "b"), F.size("a") + F.size("b")), F.lit(1.0)).alias("r")).collect()}
    for i, (a, b) in enumerate(cases):
        assert abs(got[i] - difflib.SequenceMatcher(None, a, b).ratio()) < 1e-12


def test_false_duplicate_rules(spark):
    rows = [(0, 1, []), (0, 2, []), (0, 3, ["a", "b", "c", "d"]), (0, 4, ["a", "b", "c", "x"]),
            (0, 5, ["z", "b", "c", "x"]), (0, 6, ["q", "b", "c", "x", "y"]), (0, 7, ["w", "b", "c", "x", "y"]),
            (1, 1, ["a"]), (1, 2, ["a"])]
    df = spark.createDataFrame(rows, "log_index int, url_index int, text_lines array<string>")
    wp = C.previous_in_order(df, ["log_index"], ["url_index"], ["text_lines"])
    got = {(r["log_index"], r["url_index"]): r["valid"] for r in C.flag_false_duplicates(wp).collect()}
    assert [got[(0, i)] for i in range(1, 8)] == [True, False, True, False, True, True, False]
    assert [got[(1, i)] for i in (1, 2)] == [True, False]


def test_cross_thread_previous_skips_empty_thread(spark):
    rows = [(0, 1, ["a"]), (0, 2, ["b"]), (2, 1, ["c"])]
    df = spark.createDataFrame(rows, "log_index int, url_index int, text_lines array<string>")
    wp = C.previous_in_order(df.withColumn("day", F.lit(1)), ["day"], ["log_index", "url_index"], ["text_lines"])
    got = {(r["log_index"], r["url_index"]): r["prev_text_lines"] for r in wp.collect()}
    assert got[(2, 1)] == ["b"] and got[(0, 1)] is None


def test_dense_index_on_a_hot_group(spark):
    rows = [(0 if i % 10 else 1 + i % 3, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, v int")
    idx = dense_index(df, ["g"], ["v"], name="rn", num_partitions=16, total="n")
    from pyspark.sql import Window
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("v")))
    joined = idx.join(ref, ["g", "v"])
    assert joined.filter("rn != rn2").count() == 0
    assert idx.count() == 5000
    assert {r["g"]: r["n"] for r in idx.select("g", "n").distinct().collect()}[0] == 4500


def test_day_pairs_follow_the_calendar(spark):
    rows = [("p", 20210612, ["a"]), ("p", 20210613, ["a"]), ("p", 20210615, ["b"]), ("q", 20210613, ["x"]),
            ("q", 20210615, ["x"])]
    df = spark.createDataFrame(rows, "page_id string, day int, text array<string>")
    bits = {(r["page_id"], r["day1"]): r["text_changed"] for r in D.change_bits(df, ["text"]).collect()}
    assert bits == {("p", 20210612): 0, ("p", 20210613): 1, ("q", 20210613): 0}


def test_false_duplicates_brute_force(spark, duck_check):
    """Full rule with stdlib difflib over DuckDB's lagged rows equals Spark's flags."""
    import __spark_entry__ as E
    from conftest import SF_CHECK
    from pagetide.plans.oracle import CRAWL_ORDER
    rows = duck_check.sql(f"WITH {CRAWL_ORDER} SELECT doc_id, text_lines, prev FROM cp").fetchall()
    want = {}
    for doc_id, cur, prev in rows:
        if prev is None:
            want[doc_id] = True
        else:
            want[doc_id] = (len(cur) > 0 and prev[:3] != cur[:3]
                            and difflib.SequenceMatcher(None, cur, prev).ratio() <= 0.75)
    got = {r["doc_id"]: r["valid"] for r in E.queries()["false_duplicates"](spark, SF_CHECK).collect()}
    assert got == want


def test_diff_totals_and_amplitudes_brute_force(spark):
    """Opcode totals and amplitude shares equal stdlib difflib over the snapshot pairs."""
    import __spark_entry__ as E
    from conftest import SF_SMALL
    from pagetide.plans.check import duckdb_connection
    from pagetide.plans.oracle import SNAPSHOTS
    con = duckdb_connection(SF_SMALL)
    pairs = con.sql(f"WITH {SNAPSHOTS} SELECT text_1, text_2 FROM pr").fetchall()
    ops = [opcode_counts_py(a, b) for a, b in pairs]
    want = tuple(sum(o[i] for o in ops) for i in range(3))
    got = E.queries()["diff_totals"](spark, SF_SMALL).first()
    assert (got["equal"], got["insert"], got["delete"]) == want
    changed = [o for o in ops if o[1] or o[2]]
    amp = {r["feature"]: r for r in E.queries()["change_amplitudes"](spark, SF_SMALL).collect()}
    ins = sum(o[1] / sum(o) for o in changed) / len(changed)
    assert abs(amp["text"]["insert_share"] - ins) < 1e-12


def test_hash_duplicates_textless_fallback(spark):
    rows = [(0, 1, ["a"], (1, 2)), (0, 2, ["a"], (1, 2)), (0, 3, [], (3, 4)), (0, 4, [], (3, 4)), (0, 5, [], (5, 4))]
    df = spark.createDataFrame(rows, "log_index int, url_index int, text_lines array<string>, "
                                     "counts struct<images:int,tags:int>")
    wp = C.previous_in_order(df, ["log_index"], ["url_index"], ["text_lines", "counts"])
    got = {r["url_index"]: r["valid"] for r in C.hash_duplicates(wp, counts="counts", prev_counts="prev_counts").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_dense_index_with_payload_under_sampling(spark):
    """Many rows (range bounds come from sampling) and a payload column that only
    one branch needs: numbering must still equal row_number."""
    from pyspark.sql import Window
    df = (spark.range(60000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("payload"))
              .repartition(8))
    idx = dense_index(df, ["g"], ["v"], name="rn", num_partitions=24)
    ref = df.select("g", "v", F.row_number().over(Window.partitionBy("g").orderBy("v")).alias("rn2"))
    assert idx.join(ref, ["g", "v"]).filter("rn != rn2").count() == 0
    assert idx.select("payload").distinct().count() == 60000


def test_combined_features_report_keys_that_do_not_agree(spark):
    a = spark.createDataFrame([("p", 1, 5), ("q", 1, 6), (None, 1, 7)], "page_id string, day1 int, value int")
    b = spark.createDataFrame([("p", 1, 8), ("r", 1, 9), ("r", 1, 4), (None, 1, 0)], "page_id string, day1 int, value int")
    both = D.combine_features({"a": a, "b": b}, ["page_id", "day1"])
    got = {r["page_id"]: (r["a"], r["b"], r["missing"], r["repeated"]) for r in both.collect()}
    assert got == {"p": (5, 8, [], []), "q": (6, None, ["b"], []), "r": (None, 4, ["a"], ["b"]), None: (7, 0, [], [])}
    assert sorted(r["page_id"] for r in D.disagreements(both).collect()) == ["q", "r"]
    assert D.disagreements(D.combine_features({"a": a, "b": a}, ["page_id", "day1"])).count() == 0

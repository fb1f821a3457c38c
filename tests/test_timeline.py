"""Timeline invariants on the proxy data and persistence rules on a published cube."""
from pyspark.sql import functions as F

from pagetide.operators import timeline as T
from pagetide.sources import proxies as X
from pagetide.sources.tables import Tables

from conftest import SF_SMALL

# Fixed: first published week-to-week matrix of the first seed stage (page text).
PUBLISHED_CUBE = [[25851, 1859, 893, 215, 133, 50, 20, 4], [1648, 974, 553, 289, 175, 69, 12, 10],
                  [839, 534, 710, 406, 337, 135, 44, 29], [179, 266, 389, 418, 318, 237, 104, 72],
                  [132, 138, 298, 336, 402, 288, 150, 106], [44, 77, 119, 215, 265, 424, 218, 369],
                  [10, 18, 58, 104, 191, 275, 297, 265], [4, 9, 24, 72, 79, 352, 287, 3393]]


def _bits(spark):
    return X.change_bits(Tables(spark, SF_SMALL).events)


def test_matrix_rows_sum_to_pages_and_cube_margins(spark):
    bits = _bits(spark)
    start, n_weeks = T.study_weeks(bits)
    n_pages = bits.select("page_id").distinct().count()
    m = T.change_matrix(bits, start, n_weeks)
    sums = {r["s"] for r in m.groupBy("feature", "week_no").agg(F.sum("pages").alias("s")).collect()}
    assert sums == {n_pages}
    cube = T.change_cube(bits, start, n_weeks)
    mat = {(r["feature"], r["week_no"], r["n"]): r["pages"] for r in m.collect()}
    prev = cube.groupBy("feature", "week_no", "prev_n").agg(F.sum("pages").alias("s")).collect()
    cur = cube.groupBy("feature", "week_no", "cur_n").agg(F.sum("pages").alias("s")).collect()
    assert all(mat[(r["feature"], r["week_no"] - 1, r["prev_n"])] == r["s"] for r in prev)
    assert all(mat[(r["feature"], r["week_no"], r["cur_n"])] == r["s"] for r in cur)


def test_daily_series_sums_to_bits(spark):
    bits = _bits(spark)
    daily = T.daily_changes(bits).filter("feature = 'text'").agg(F.sum("changed")).first()[0]
    assert daily == bits.agg(F.sum("text_changed")).first()[0]


def _cube_df(spark):
    rows = [("text", 1, 25, i, j, PUBLISHED_CUBE[i][j]) for i in range(8) for j in range(8)]
    return spark.createDataFrame(rows, "feature string, week_no int, week int, prev_n int, cur_n int, pages long")


def test_persistence_on_published_cube(spark):
    cube = _cube_df(spark)
    m = PUBLISHED_CUBE
    got = {r["prev_n"]: r["fraction"] for r in T.persistence(cube).collect()}
    for i in range(8):
        assert abs(got[i] - m[i][i] / sum(m[i])) < 1e-12
    all8 = T.persistence_all(cube).first()
    assert abs(all8["same8"] - sum(m[i][i] for i in range(8)) / sum(map(sum, m))) < 1e-12
    same3 = m[0][0] + m[7][7] + sum(m[i][j] for i in range(1, 7) for j in range(1, 7))
    assert abs(all8["same3"] - same3 / sum(map(sum, m))) < 1e-12
    p3 = {r["prev_class"]: r["fraction"] for r in T.persistence3(cube).collect()}
    assert abs(p3[1] - sum(m[i][j] for i in range(1, 7) for j in range(1, 7)) / sum(sum(m[i]) for i in range(1, 7))) < 1e-12


def test_neighbour_moves_on_published_cube(spark):
    cube = _cube_df(spark)
    m = PUBLISHED_CUBE
    got = {r["prev_n"]: r["fraction"] for r in T.neighbour_moves(cube).collect()}
    for i in range(8):
        near = (m[i][i - 1] if i > 0 else 0) + (m[i][i + 1] if i < 7 else 0)
        assert abs(got[i] - near / sum(m[i])) < 1e-12
    g3 = {r["prev_class"]: r["fraction"] for r in T.neighbour_moves3(cube).collect()}
    assert abs(g3[0] - (sum(m[0]) - m[0][0] - m[0][7]) / sum(m[0])) < 1e-12
    some = sum(m[i][0] + m[i][7] for i in range(1, 7)) / sum(sum(m[i]) for i in range(1, 7))
    assert abs(g3[1] - some) < 1e-12
    assert abs(g3[2] - (sum(m[7]) - m[7][0] - m[7][7]) / sum(m[7])) < 1e-12


def test_rare_changes_threshold(spark):
    rows = [("s00-1", f"2021-06-{d:02d}", 1, 0, 0) for d in (13, 14)] + \
           [("s00-2", f"2021-06-{d:02d}", 1, 0, 0) for d in range(13, 30)]
    df = spark.createDataFrame(rows, "page_id string, day2 string, text_changed int, ilinks_changed int, "
                                     "elinks_changed int").withColumn("day2", F.to_date("day2"))
    got = {str(r["day2"]): r["rare_changes"] for r in T.rare_changes(df, 89, 0.1).collect()}
    assert got == {"2021-06-13": 1, "2021-06-14": 1}


def test_complete_weeks_of_the_study_span(spark):
    df = spark.createDataFrame([("s00-1", "2021-06-13"), ("s00-1", "2021-09-09")], "page_id string, day2 string") \
              .withColumn("day2", F.to_date("day2"))
    assert T.week_bounds(df) == (24, 35)
    assert T.week_bounds(df, complete_only=False) == (23, 36)


def test_study_across_new_year(spark):
    days = ["2021-12-27", "2021-12-28", "2022-01-03", "2022-01-04", "2022-01-10", "2022-01-16"]
    rows = [("s00-1", d, 1, 0, 0) for d in days]
    df = spark.createDataFrame(rows, "page_id string, day2 string, text_changed int, ilinks_changed int, "
                                     "elinks_changed int").withColumn("day2", F.to_date("day2"))
    start, n = T.study_weeks(df)
    assert (str(start), n) == ("2021-12-27", 3)
    m = {(r["week_no"], r["week"]): r["pages"] for r in
         T.change_matrix(df, start, n).filter("feature = 'text' AND pages > 0").collect()}
    assert m == {(0, 52): 1, (1, 1): 1, (2, 2): 1}
    edges = T.alluvial_edges(T.change_cube(df, start, n)).filter("feature = 'text' AND value > 0").collect()
    assert sorted((r["source"], r["target"]) for r in edges) == [(2, 10), (10, 18)]

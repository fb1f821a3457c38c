"""Hand-made frames for URL, link and HTML cases the driver tables lack."""
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.functions import urls as U
from pagetide.operators import pages as P
from pagetide.operators import seeds as SD


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_href_cases(spark):
    hrefs = ["", "/", "x", "/x/", "#top", "http://a.nl/", "https://b.c.nl", "http://http://a.nl"]
    got = _one(spark, [(h,) for h in hrefs], "h string", U.href_to_url(F.col("h"), F.lit("a.nl"), F.lit("a.nl/p/q")))
    assert got == ["a.nl/p/q", "a.nl/p/q", "a.nl/p/q/x", "a.nl/x", "a.nl/p/q/#top", "a.nl", "b.c.nl", "a.nl"]


def test_url_helpers(spark):
    urls = ["https://a.b.c.nl/d/e/f", "localhost", "x.nl:8080/y", "http://ex-1.nl/", "https://https://q.r.org"]
    assert _one(spark, [(u,) for u in urls], "u string", U.root_domain("u")) == [
        "a.b.c.nl", "localhost", "x.nl:8080", "ex-1.nl", "q.r.org"]
    assert _one(spark, [(u,) for u in urls], "u string", U.sl_domain("u")) == ["c", "localhost", "x", "ex-1", "r"]
    df = spark.createDataFrame([(1, "https://a.b.c.nl/d/e/f"), (2, "http://ex-1.nl/")], "page_id long, url string")
    got = {r["page_id"]: r.asDict() for r in P.url_features(df).collect()}
    assert (got[1]["url_length"], got[1]["domain_name_length"], got[1]["url_subdir_depth"],
            got[1]["url_subdomain_depth"], got[1]["protocol"]) == (22, 1, 3, 2, 1)
    assert (got[2]["domain_name_length"], got[2]["domain_name_digits"], got[2]["domain_name_special_chars"],
            got[2]["url_subdir_depth"], got[2]["url_subdomain_depth"], got[2]["protocol"]) == (4, 1, 1, 1, 0, 0)


PAGE = """<html><head><meta charset="utf-8"><meta name="x"><title>T</title></head><body>
<!-- <img src="hidden.png"> <a href="/commented">c</a> -->
<script>var s = "<a href='/inscript'>x</a><img src=q>";</script>
<IMG SRC="a.png"><img src='b.png'/>
<table><tr><td><table><tr><td>in</td></tr></table></td></tr></table>
<p><a href=unquoted>u</a> <a name="nohref">n</a> <A HREF="mailto:me@x.nl">m</A></p>
<p><a href="https://other.org/p">o</a> <a class="k" href=" /spaced/ ">s &amp; t</a></p>
</body></html>"""


def test_html_elements(spark):
    df = spark.createDataFrame([(1, "http://www.site.nl/p", PAGE)], "page_id long, url string, html string")
    links = P.link_lists(df).first()
    assert links["internal_outlinks"] == ["www.site.nl/p/unquoted", "www.site.nl/spaced"]
    assert links["external_outlinks"] == ["other.org/p"]
    assert links["email_links"] == ["mailto:me@x.nl"]
    h = P.html_features(df).first()
    assert (h["images"], h["scripts"], h["tables"], h["meta"]) == (2, 1, 2, 2)
    assert (h["tags_total"], h["tags_unique"]) == (22, 12)
    lines = df.select(H.text_lines("html").alias("t")).first()["t"]
    assert "in" in lines and "o s & t" in lines
    assert not any("var s" in x or "hidden" in x or x == "T" for x in lines)


def test_invalid_pages(spark):
    big = "<html>" + "x" * (10 * 1048576)
    rows = [(1, "<html><body>ok</body></html>"), (2, "<body>no root</body>"), (3, ""), (4, big),
            (5, "<!-- <html> --><p>commented</p>"), (6, "<HTML lang=en>upper</HTML>")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    assert sorted(r[0] for r in P.valid_pages(df).select("page_id").collect()) == [1, 6]


def test_dump_link_edges(spark):
    lines = ["http://start.nl/x at line start is not found",
             "see [http://a.nl/] and x http://nodot y",
             "=http://a.nl// two slashes",
             "ref=http://a.nl/?a=1&amp;b=2 end",
             '"https://q.r.org/p|rest']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "page_id long, line string")
    got = [r["link"] for r in SD.dump_links(df).orderBy("page_id", "link_no").collect()]
    assert got == ["http://a.nl", "http://a.nl/", "http://a.nl/?a=1&b=2", "https://q.r.org/p"]


def test_seed_limits_and_stages(spark):
    links = [(f"http://s{i % 7}.big.nl/{i}",) for i in range(300)] + [("http://only.small.org/a",)] * 3 + \
            [("no-protocol.nl",), ("http://onelabel/x",)]
    df = spark.createDataFrame(links, "link string")
    lim = SD.limit_per_domain(df, limit=50)
    per = {r["sld"]: r["count"] for r in lim.groupBy("sld").count().collect()}
    assert per == {"big.nl": 50, "small.org": 1}
    pop = SD.limit_per_domain(df, limit=2, by_popularity=True).filter("sld = 'small.org'").first()
    assert (pop["stage"], pop["n"]) == (0, 3)
    sizes = {r["stage"]: (r["urls"], r["percentage"]) for r in SD.stage_sizes(lim).collect()}
    assert sizes[0] == (2, 100.0) and sizes[1] == (1, 50.0)


def test_tld_and_split(spark):
    df = spark.createDataFrame([("http://A.example.NL/x",), ("https://b.example.com",), ("http://c.nl",)], "link string")
    assert sorted(r[0] for r in SD.tld_filter(df, "nl").collect()) == ["http://A.example.NL/x", "http://c.nl"]
    first = spark.createDataFrame([(f"http://d{i}.nl/",) for i in range(10)], "link string")
    split = SD.split_domains(first, 0.8)
    assert split.filter("train").count() == 8 and split.count() == 10


def test_bernoulli_consideration(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("link"))
    kept = SD.consider(df, 0.25).count()
    assert 4500 < kept < 5500
    assert SD.consider(df, 1.0).count() == 20000


def test_unescape_matches_python(spark):
    import html
    cases = ["caf&#233; &#x41;&amp;&lt; &#8217;x &#0; &#55296; a&b", "&amp;#233; &#38;lt; &#233 &#xE9x &#99999999999;",
             "&nbsp;&apos;&quot;&gt;", "plain", "", "&", "&#x1F600; &#128512;", "a &unknown; b"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(H.unescape("t")).collect()]
    assert got == [html.unescape(c) for c in cases]

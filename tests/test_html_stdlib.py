"""Page extraction and character references against the standard library, without the engine's own patterns."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.operators import pages as P
from pagetide.sources.tables import Tables

ROOT = "/root/testdata/sf0.01"
REFERENCES = ["&copy; &middot;x", "&notit; &notin; &not", "&amp;lt; &ampere &", "&#128;&#129;&#150;", "&#1;a&#11;b&#xFFFF;c",
              "&#0;&#xD800;&#x110000;&#99999999999999999999;", "&nosuchname; &nosuch", "&CounterClockwiseContourIntegral;",
              "&Afr;&NewLine;&hearts", "a&b&c;d", "&#x1F600;&#32", "plain", "", "&frac12x;&acirc", "&;&&#;&#x;"]


class Reader(HTMLParser):
    """Tag names, link targets and element lists of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.links, self.images, self.metas, self.scripts = [], [], 0, 0, 0

    def handle_starttag(self, tag, attrs):
        self.tags.append(tag)
        self.images += tag == "img"
        self.metas += tag == "meta"
        self.scripts += tag == "script"
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"].strip())

    handle_startendtag = handle_starttag


@pytest.fixture(scope="module")
def read_pages(spark):
    found = {}
    for page_id, source in Tables(spark, ROOT).pages.select("page_id", "html").toLocalIterator():
        reader = Reader()
        reader.feed(source)
        reader.close()
        found[page_id] = (reader, source)
    return found


def test_references_as_the_standard_library(spark):
    df = spark.createDataFrame(list(enumerate(REFERENCES)), "i int, s string")
    got = {r["i"]: r["u"] for r in df.select("i", H.unescape("s").alias("u")).collect()}
    assert got == {i: html.unescape(s) for i, s in enumerate(REFERENCES)}


def test_table_of_names_is_one_literal(spark):
    plan = spark.range(1).select(H.unescape(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan


def test_all_pages_tags_links_and_elements(spark, read_pages):
    pages = Tables(spark, ROOT).pages
    links = {r["page_id"]: r["h"] for r in pages.select("page_id", H.hrefs("html").alias("h")).collect()}
    assert links == {k: reader.links for k, (reader, _) in read_pages.items()}
    for r in P.html_lists(pages).collect():
        reader = read_pages[r["page_id"]][0]
        assert r["html_tags"] == reader.tags
        assert (len(r["images"]), len(r["meta"]), len(r["scripts"])) == (reader.images, reader.metas, reader.scripts)


def test_no_page_text_keeps_a_known_name(spark, read_pages):
    rows = Tables(spark, ROOT).pages.select("page_id", H.text_lines("html").alias("t")).collect()
    for r in rows:
        text, source = "\n".join(r["t"]), read_pages[r["page_id"]][1]
        # A reference may only remain where the source escapes its ampersand.
        escaped = set(re.findall(r"&[a-zA-Z]+;", html.unescape(source)))
        assert set(re.findall(r"&[a-zA-Z]+;", text)) <= escaped


class TableReader(HTMLParser):
    """Source text of every table element, by the parser's own positions."""

    def __init__(self, source):
        super().__init__(convert_charrefs=False)
        self.source, self.lines, self.open, self.found = source, [0], [], []
        for line in source.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))

    def here(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append(len(self.found))
            self.found.append([self.here(), len(self.source)])

    handle_startendtag = handle_starttag  # HTML knows no empty-element tags but the void ones

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            end = self.source.index(">", self.here()) + 1
            self.found[self.open.pop()][1] = end

    def texts(self):
        self.feed(self.source)
        self.close()
        return [self.source[a:b] for a, b in self.found]


NESTED = ["<table><tr><td>a<table class=x><td>b</table>c</table><TABLE\nid=2>d</TABLE >", "</table><table>x", "<table><table>y</table>z", "no tables",
          "<tablet>n</tablet><table/><p></table>", "", "<table>" * 40 + "deep" + "</table>" * 40, "<table>1</table>" * 30, "a</table></table>b<table>c</table>d</table>"]


def test_table_elements_as_the_parser_spans_them(spark):
    df = spark.createDataFrame(list(enumerate(NESTED)) + [(99, None)], "i int, html string")
    got = {r["i"]: r["t"] for r in df.select("i", H.nested_elements("html", H.TABLE_TAG_RE).alias("t")).collect()}
    assert got.pop(99) is None
    assert got == {i: TableReader(source).texts() for i, source in enumerate(NESTED)}


def test_table_elements_of_all_crawl_pages(spark):
    from pagetide.sources import proxies as X
    series = X.crawl_series(spark.read.parquet(ROOT + "/pages.parquet"))
    step = series.select("day", "page_key", H.blank_script_bodies("html").alias("clean"))
    rows = step.select("clean", H.nested_elements("clean", H.TABLE_TAG_RE).alias("t")).collect()
    assert len(rows) == 1000 and sum(len(r["t"]) for r in rows) > 1000
    for r in rows:
        assert r["t"] == TableReader(r["clean"]).texts()


def test_a_changed_cell_changes_the_tables(spark):
    source = "<html><body><table><tr><td>{}</td></tr></table></body></html>"
    df = spark.createDataFrame([(1, source.format("a")), (2, source.format("b"))], "page_id int, html string")
    one, two = P.html_lists(df).orderBy("page_id").collect()
    assert one["tables"] != two["tables"] and one["html_tags"] == two["html_tags"]


BLOCKS = set("p div br h1 h2 h3 h4 h5 h6 li ul ol tr td th table thead tbody tfoot section article header footer nav aside main blockquote pre hr dl dt dd "
             "form fieldset figure figcaption address title option caption body html".split())


class LineReader(HTMLParser):
    """Text lines of a page, written from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.unseen, self.text = None, []

    def handle_starttag(self, tag, attrs):
        if self.unseen is None and tag in ("head", "script", "style"):
            self.unseen = tag
        if tag in BLOCKS:
            self.handle_data("\n")

    def handle_endtag(self, tag):
        if tag == self.unseen:
            self.unseen = None
        elif tag in BLOCKS:
            self.handle_data("\n")

    def handle_data(self, data):
        if self.unseen is None:
            self.text.append(data)

    def lines(self, source):
        self.feed(source)
        self.close()
        return [line.strip() for line in re.split(r"\r?\n|\r", "".join(self.text)) if line.strip()]


def test_text_lines_as_the_parser_reads_them(spark):
    from pagetide.sources import proxies as X
    pages = spark.read.parquet(ROOT + "/pages.parquet")
    for source in (pages, X.crawl_series(pages)):
        rows = source.select("html", H.text_lines("html").alias("t")).collect()
        assert sum(len(r["t"]) for r in rows) > 1000
        for r in rows:
            assert r["t"] == LineReader().lines(r["html"])

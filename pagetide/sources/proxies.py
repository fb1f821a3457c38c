"""Stand-in inputs derived from the driver tables.

The engine's native inputs are crawl logs, page snapshots and change bits.
The test tables carry none of them, so each view below derives one from the
given tables with plain DataFrame operations (documented as SQL in
FIXTURES.md §3, and repeated in ``pagetide/plans/oracle.py``).  All views scan
their table once and grow with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.functions.dates import truncate_to_second
from pagetide.functions.html import let, replaced
from pagetide.operators.ordering import dense_index


def change_bits(events: DataFrame) -> DataFrame:
    """A user is a page, a date is a crawl-day pair, three event types are the change bits."""
    day = F.to_date(F.col("ts"))

    def bit(kind):
        return F.max(F.when(F.col("event_type") == kind, 1).otherwise(0))

    agg = (events.groupBy("user_id", day.alias("day2"))
                 .agg(bit("view").alias("text_changed"), bit("click").alias("ilinks_changed"),
                      bit("purchase").alias("elinks_changed")))
    page_id = F.concat(F.lit("s"), F.lpad((F.col("user_id") % 3).cast("string"), 2, "0"), F.lit("-"),
                       F.col("user_id").cast("string"))
    return agg.select(page_id.alias("page_id"), "day2", "text_changed", "ilinks_changed", "elinks_changed")


def snapshots(documents: DataFrame) -> DataFrame:
    """Two crawl days per document; day 1 is a fixed rewrite of day 0.

    Features: ``text`` (lines), ``internal_outlinks`` (source, informative
    stand-in, changed when doc_id % 5 = 0) and ``meta`` (language, uninformative
    stand-in, changed when doc_id % 7 = 0); ``page_hash`` digests all three.
    """
    nl = F.lit("\n")
    doc = F.col("doc_id")
    text1 = (F.when(doc % 4 == 0, F.col("text"))
              .when(doc % 4 == 1, F.concat(F.col("text"), nl, F.lit("added line")))
              .when(doc % 4 == 2, F.concat(F.lit("new head"), nl, F.col("text")))
              .otherwise(F.replace(F.col("text"), F.lit(" the "), F.lit(" de "))))
    source1 = F.when(doc % 5 == 0, F.concat(F.col("source"), F.lit("-moved"))).otherwise(F.col("source"))
    lang1 = F.when(doc % 7 == 0, F.concat(F.col("lang"), F.lit("-alt"))).otherwise(F.col("lang"))
    day0 = F.struct(F.lit(0).alias("day_no"), F.col("text").alias("t"), F.col("source").alias("s"),
                    F.col("lang").alias("l"))
    day1 = F.struct(F.lit(1).alias("day_no"), text1.alias("t"), source1.alias("s"), lang1.alias("l"))
    days = documents.select(doc.alias("page_id"), F.explode(F.array(day0, day1)).alias("d"))
    return days.select(
        "page_id", F.col("d.day_no").alias("day_no"),
        F.split(F.col("d.t"), "\n").alias("text"),
        F.array(F.col("d.s")).alias("internal_outlinks"),
        F.array(F.col("d.l")).alias("meta"),
        F.md5(F.concat_ws("\u0001", F.col("d.t"), F.col("d.s"), F.col("d.l"))).alias("page_hash"))


# Fixed values of the crawl series (FIXTURES.md): four crawl days, none on the 14th.
SERIES_DAYS = ["2021-06-12", "2021-06-13", "2021-06-15", "2021-06-16"]
# Edits of a page's source on every day: lists become nested tables with images, an e-mail and an external link are added.
SERIES_BASE = [("<ul>", '<table class="nav"><tr><td><table>'), ("</ul>", "</table></td></tr></table>"),
               ("<li>", '<tr><td><img src="/i.png">'), ("</li>", "</td></tr>"),
               ("</nav>", '</nav><a href="mailto:info@example.org">mail</a><a href="https://other.org/x">out</a>')]
# (first day, last day, modulus, remainder, text, new text): edits of the pages with page_id % modulus = remainder.
SERIES_EDITS = [(1, 3, 3, 1, "</article>", "<p>news of today</p></article>"), (1, 1, 5, 0, "/i.png", "/j.png"),
                (2, 3, 5, 2, "</table></td></tr></table>", "<tr><td>new cell</td></tr></table></td></tr></table>"),
                (3, 3, 7, 3, "other.org", "elsewhere.net"), (2, 3, 4, 1, "</nav>", '<a href="/extra">x</a></nav>'),
                (1, 1, 6, 0, '<meta charset="utf-8">', '<meta charset="utf-8"><meta name="day" content="1">'),
                (2, 2, 8, 1, "track(0)", "track(2)"), (1, 2, 9, 2, "info@", "post@"), (2, 2, 10, 8, "</article>", "<i>b</i></article>")]
# (day, modulus, remainders, source): pages replaced by a fixed one.
SERIES_REPLACED = [(2, 10, (4, 5), "<html><head></head><body><p>Service unavailable</p></body></html>"),
                   (3, 10, (6, 7), '<html><head></head><body><img src="/x.png"></body></html>')]
SERIES_FAILED, SERIES_ABSENT = (1, 11, 0), (2, 13, 0)  # (day, modulus, remainder): fetch failed; file missing
SERIES_THREAD = 50  # pages per crawler thread


def crawl_series(pages: DataFrame) -> DataFrame:
    """Crawl log and pages of several days: each page's source with day-dependent edits.

    (day, ts, log_index, stage_file, stage_index, url_index, status, file_present, url, page_key, html)
    """
    p, d = F.col("page_id"), F.col("d")
    # Edits of every day are made once, before the page is repeated day by day.
    base = F.col("html")
    for find, new in SERIES_BASE:
        base = replaced(base, find, new)
    based = pages.select("page_id", "url", base.alias("html"))

    def edit(source, rule, find, new):  # the source stands in the expression once, and no page is searched that stays as it is
        return let(source, lambda x: F.when(rule, replaced(x, find, new)).otherwise(x))

    html = F.col("html")
    for lo, hi, modulus, rest, find, new in SERIES_EDITS:
        html = edit(html, d.between(lo, hi) & (p % modulus == rest), find, new)
    for at, modulus, rests, source in SERIES_REPLACED:
        html = F.when((d == at) & (p % modulus).isin(*rests), F.lit(source)).otherwise(html)

    def on(rule):
        return (d == rule[0]) & (p % rule[1] == rule[2])

    day = F.get(F.array(*[F.lit(x) for x in SERIES_DAYS]), d).cast("date")
    return based.select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(len(SERIES_DAYS) - 1))).alias("d")).select(
        day.alias("day"), F.date_format(day + F.make_dt_interval(hours=F.lit(10), mins=(p % 60).cast("int")), "yyyyMMddHHmmss").alias("ts"),
        F.floor(p / SERIES_THREAD).cast("int").alias("log_index"), F.lit("links_s00").alias("stage_file"), F.lit(0).alias("stage_index"),
        p.cast("int").alias("url_index"), F.when(on(SERIES_FAILED), "RequestStatus.HEADLESS_FAILED").otherwise("RequestStatus.HEADLESS_SUCCESS").alias("status"),
        (~on(SERIES_ABSENT)).alias("file_present"), "url", F.concat(F.lit("links_s00-"), p.cast("string")).alias("page_key"), html.alias("html"))


def crawl_order(documents: DataFrame) -> DataFrame:
    """Crawl log stand-in: source number = log index, source % 4 = crawler thread,
    URL index = rank of (text, doc_id) inside the thread."""
    src = F.substring(F.col("source"), 4, 1 << 20).try_cast("int")
    base = documents.select("doc_id", "text", src.alias("log_index"), (src % 4).alias("thread"))
    ranked = dense_index(base, ["thread"], ["text", "doc_id"], name="url_index")
    return ranked.select("doc_id", "log_index", "url_index", "thread",
                         F.split(F.col("text"), "\n").alias("text_lines"))


def log_rows(events: DataFrame) -> DataFrame:
    """Crawl-log rows at one-second grain; ``error`` events are the threat list."""
    return events.select("event_id", truncate_to_second(F.col("ts")).alias("ts"),
                         F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_threat"))


def text_counts(documents: DataFrame) -> DataFrame:
    """Five text counts of every document."""
    t = F.col("text")

    def occurrences(ch):
        return (F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))).cast("int")

    return documents.select(
        F.col("doc_id").cast("string").alias("page_id"), F.col("n_chars").cast("int").alias("f_chars"),
        (occurrences("\n") + 1).alias("f_lines"), occurrences(" ").alias("f_spaces"),
        occurrences(".").alias("f_dots"), occurrences(",").alias("f_commas"))


def training(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Five text counts as features, document quality as label."""
    rated = labels.select(F.col("doc_id").cast("string").alias("page_id"), F.col("quality").alias("label"))
    return text_counts(documents).join(rated, "page_id")


TRAINING_FEATURES = ["f_chars", "f_lines", "f_spaces", "f_dots", "f_commas"]


def categories(events: DataFrame) -> DataFrame:
    """Manual-label stand-in: comma list of a user's event types per day."""
    return (events.groupBy("user_id", F.to_date("ts").alias("day"))
                  .agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("categories"))
                  .select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("day").cast("string"))
                          .alias("page"), "categories"))


def wiki_lines(pages: DataFrame) -> DataFrame:
    """Dump-line stand-in: a line with the page's own URL twice (once escaped), then every line of its source."""
    own = F.concat(F.lit("* ["), F.col("url"), F.lit(" x] ref="), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")),
                   F.lit(" end"))
    source = F.coalesce(F.split(F.col("html"), "\n"), F.array().cast("array<string>"))
    return pages.select("page_id", F.posexplode(F.concat(F.array(own), source)).alias("line_no", "line"))


def ranked_domains(pages: DataFrame) -> DataFrame:
    """Ranked-domain list stand-in: host and count per host."""
    host = F.substring_index(F.try_element_at(F.split(F.col("url"), "://"), F.lit(2)), "/", 1)
    return pages.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))

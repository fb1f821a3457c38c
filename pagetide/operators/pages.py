"""Page feature extraction (one scan, map-only, no Python in the hot path).

Each operator is ``DataFrame -> DataFrame`` over a page table with a URL and
an HTML column.  The cleaning passes (comments, scripts) are materialised in one projection and
consumed by the next; Catalyst does not collapse projections that would
duplicate non-trivial expressions, so each of them runs once per page (``cleaned``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions import dates as D
from pagetide.functions import html as H
from pagetide.functions import urls as U

MAX_PAGE_BYTES = 10 * 1048576  # pages above 10 MiB count as not present

# The nine list features, in feature-vector order (fixed).
FEATURES = ["email_links", "external_outlinks", "images", "internal_outlinks", "meta", "text", "scripts",
            "tables", "html_tags"]


def _keys(df: DataFrame, keys) -> list[str]:
    return [k for k in keys if k in df.columns]


def cleaned(pages: DataFrame, keep: dict[str, Column], html: str = "html", only_valid: bool = False) -> DataFrame:
    """(``keep``, _nc, _bare, _clean): each page's source without comments, without scripts and styles as well, and with their
    bodies emptied.  Everything else is taken from these three, so each cleaning pass runs once per page.

    With ``only_valid`` only pages of at most 10 MiB that hold an ``<html>`` element.  The row number keeps the filter
    where it stands: pushed below the projection, it would run the passes a second time.
    """
    source = pages.where(F.octet_length(html) <= MAX_PAGE_BYTES) if only_valid else pages
    step = source.select(*[c.alias(n) for n, c in keep.items()], H.without_comments(html).alias("_nc"))
    step = step.select(*keep, "_nc", H.scripts_out("_nc").alias("_bare"), H.script_bodies_out("_nc").alias("_clean"),
                       F.monotonically_increasing_id().alias("_row"))
    if only_valid:
        step = step.where((F.col("_row") >= 0) & H.has_html_tag("_clean"))
    return step.select(*keep, "_nc", "_bare", "_clean")


def link_lists(pages: DataFrame, keys=("page_id",), url: str = "url", html: str = "html",
               strip_base: bool = True) -> DataFrame:
    """Outlinks of each page: ``internal_outlinks``, ``external_outlinks``,
    ``email_links`` as arrays in page order."""
    ks = _keys(pages, keys)
    step1 = pages.select(*ks, F.col(url).alias("_url"), H.hrefs(html).alias("_hrefs"))
    step2 = step1.select(*ks, "_url", H.resolve_links("_url", "_hrefs", strip_base).alias("_r"))
    step3 = step2.select(*ks, "_url", F.col("_r.email").alias("email_links"),
                         H.tag_internal("_r.resolved", "_r.sld").alias("_t"))
    return step3.select(*ks, F.col("_url").alias(url), H.internal_links("_t").alias("internal_outlinks"),
                        H.external_links("_t").alias("external_outlinks"), "email_links")


def page_linkage(pages: DataFrame, keys=("page_id",), url: str = "url", html: str = "html",
                 strip_base: bool = True) -> DataFrame:
    """Link counts per page plus an MD5 digest of each resolved list."""
    ks = _keys(pages, keys)
    links = link_lists(pages, ks, url, html, strip_base)
    return links.select(
        *ks,
        F.size("internal_outlinks").alias("internal_outlinks"),
        F.size("external_outlinks").alias("external_outlinks"),
        F.size("email_links").alias("email_links"),
        F.md5(F.array_join("internal_outlinks", "\n")).alias("internal_md5"),
        F.md5(F.array_join("external_outlinks", "\n")).alias("external_md5"))


def url_features(df: DataFrame, keys=("page_id",), url: str = "url") -> DataFrame:
    """URL scalar features: length, second-level label length / digits / other
    characters, path depth, subdomain depth, protocol flag."""
    ks = _keys(df, keys)
    step = df.select(*ks, F.col(url).alias("_url"), U.sl_domain(url).alias("_sld"))
    return step.select(
        *ks,
        F.length("_url").alias("url_length"),
        F.length("_sld").alias("domain_name_length"),
        U.digit_count("_sld").alias("domain_name_digits"),
        U.special_char_count("_sld").alias("domain_name_special_chars"),
        U.url_subdir_depth("_url").alias("url_subdir_depth"),
        U.url_subdomain_depth("_url").alias("url_subdomain_depth"),
        U.protocol_flag("_url").alias("protocol"))


def html_lists(pages: DataFrame, keys=("page_id",), html: str = "html") -> DataFrame:
    """Element lists: images, scripts, tables, metas as their source text and all tag names.  Tables hold all they
    enclose (comments and script or style bodies left out), nested tables also on their own."""
    ks = _keys(pages, keys)
    step = pages.select(*ks, H.without_comments(html).alias("_nc"))
    step = step.select(*ks, "_nc", H.script_bodies_out("_nc").alias("_clean"))
    return step.select(
        *ks,
        F.regexp_extract_all("_clean", F.lit(H.VOID_ELEMENT_RE["images"]), 0).alias("images"),
        F.regexp_extract_all("_nc", F.lit(H.SCRIPT_ELEMENT_RE), 0).alias("scripts"),
        H.nested_elements("_clean", H.TABLE_TAG_RE).alias("tables"),
        F.regexp_extract_all("_clean", F.lit(H.VOID_ELEMENT_RE["metas"]), 0).alias("meta"),
        F.transform(F.regexp_extract_all("_clean", F.lit(H.TAG_NAME_RE), 1), lambda n: F.lower(n))
         .alias("html_tags"))


def html_features(pages: DataFrame, keys=("page_id",), html: str = "html") -> DataFrame:
    """HTML count features: images, scripts, tables, meta, tags_total, tags_unique."""
    ks = _keys(pages, keys)
    lists = html_lists(pages, ks, html)
    return lists.select(
        *ks, F.size("images").alias("images"), F.size("scripts").alias("scripts"),
        F.size("tables").alias("tables"), F.size("meta").alias("meta"),
        F.size("html_tags").alias("tags_total"), F.size(F.array_distinct("html_tags")).alias("tags_unique"))


def text_features(pages: DataFrame, keys=("page_id",), html: str = "html") -> DataFrame:
    """Text lines and word counts (total and distinct after lower-casing)."""
    ks = _keys(pages, keys)
    step = pages.select(*ks, H.text_lines(html).alias("text"))
    step = step.select(*ks, "text", H.words("text").alias("_w"))
    return step.select(
        *ks, F.size("text").alias("text_lines"), F.size("_w").alias("words_total"),
        F.size(F.array_distinct(F.transform("_w", lambda w: F.lower(w)))).alias("words_unique"),
        F.md5(H.one_line("text")).alias("text_md5"))


def text_and_counts(pages: DataFrame, keys=("page_id",), html: str = "html") -> DataFrame:
    """Text lines, and a struct of the six HTML counts that stand in for the text of a page without any."""
    ks = _keys(pages, keys)
    step = cleaned(pages, {k: F.col(k) for k in ks}, html)
    step = step.select(
        *ks, H.lines_in("_bare").alias("text"), F.size(F.regexp_extract_all("_clean", F.lit(H.VOID_ELEMENT_RE["images"]), 0)).alias("images"),
        F.size(F.regexp_extract_all("_nc", F.lit(H.SCRIPT_ELEMENT_RE), 0)).alias("scripts"),
        F.size(F.regexp_extract_all("_clean", F.lit(H.TABLE_OPEN_RE), 0)).alias("tables"),
        F.size(F.regexp_extract_all("_clean", F.lit(H.VOID_ELEMENT_RE["metas"]), 0)).alias("meta"),
        F.transform(F.regexp_extract_all("_clean", F.lit(H.TAG_NAME_RE), 1), lambda n: F.lower(n)).alias("_tags"))
    return step.select(*ks, "text", F.struct("images", "scripts", "tables", "meta", F.size("_tags").alias("tags_total"),
                                             F.size(F.array_distinct("_tags")).alias("tags_unique")).alias("counts"))


def valid_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages that are present (at most 10 MiB) and contain an ``<html>`` element."""
    return pages.filter((F.octet_length(html) <= MAX_PAGE_BYTES) & H.has_html_element(html))


def static_features(pages: DataFrame, keys=("page_id",), url: str = "url", html: str = "html",
                    ts: str | None = None) -> DataFrame:
    """Full static feature row of each valid page: meta (size, source hash, weekday
    when a crawl timestamp is given), URL, linkage, HTML and text features.
    Chained projections over one scan; every cleaning pass runs once."""
    ks = _keys(pages, keys)
    meta = [F.octet_length(html).alias("size"), F.md5(F.col(html)).alias("source_md5")]
    if ts:
        meta.append(D.weekday(ts).alias("weekday"))
    meta_names = ["size", "source_md5"] + (["weekday"] if ts else [])
    keep = {**{k: F.col(k) for k in ks}, **dict(zip(meta_names, meta, strict=True)), "_url": F.col(url)}
    step1 = cleaned(pages, keep, html, only_valid=True).select(
        *keep, "_nc", "_clean", H.hrefs_in("_bare").alias("_hrefs"), H.lines_in("_bare").alias("_text"))
    step2 = step1.select(
        *ks, *meta_names, "_url", "_nc", U.sl_domain("_url").alias("_sld"),
        H.resolve_links("_url", "_hrefs").alias("_r"), "_clean", H.words("_text").alias("_w"))
    step3 = step2.select(
        *ks, *meta_names,
        F.length("_url").alias("url_length"),
        F.length("_sld").alias("domain_name_length"),
        U.digit_count("_sld").alias("domain_name_digits"),
        U.special_char_count("_sld").alias("domain_name_special_chars"),
        U.url_subdir_depth("_url").alias("url_subdir_depth"),
        U.url_subdomain_depth("_url").alias("url_subdomain_depth"),
        U.protocol_flag("_url").alias("protocol"),
        H.tag_internal("_r.resolved", "_r.sld").alias("_t"),
        F.size("_r.email").alias("email_links"),
        F.size(F.regexp_extract_all("_clean", F.lit(H.VOID_ELEMENT_RE["images"]), 0)).alias("images"),
        F.size(F.regexp_extract_all("_nc", F.lit(H.SCRIPT_ELEMENT_RE), 0)).alias("scripts"),
        F.size(F.regexp_extract_all("_clean", F.lit(H.TABLE_OPEN_RE), 0)).alias("tables"),
        F.size(F.regexp_extract_all("_clean", F.lit(H.VOID_ELEMENT_RE["metas"]), 0)).alias("meta"),
        F.transform(F.regexp_extract_all("_clean", F.lit(H.TAG_NAME_RE), 1), lambda n: F.lower(n)).alias("_tags"),
        F.size("_w").alias("words_total"),
        F.size(F.array_distinct(F.transform("_w", lambda w: F.lower(w)))).alias("words_unique"))
    rest = [c for c in step3.columns if c not in ("_t", "_tags")]
    return step3.select(*rest,
                        F.size(F.filter("_t", lambda t: t["i"])).alias("internal_outlinks"),
                        F.size(F.filter("_t", lambda t: ~t["i"])).alias("external_outlinks"),
                        F.size("_tags").alias("tags_total"),
                        F.size(F.array_distinct("_tags")).alias("tags_unique"))


def page_feature_lists(pages: DataFrame, keys=("page_id",), url: str = "url", html: str = "html",
                       strip_base: bool = True, text: str | None = None) -> DataFrame:
    """The nine list features of each valid page (the per-day extraction job):
    text lines, three link lists, images, scripts, tables, metas, tag names.
    One scan, three chained projections, no shuffle.  ``text`` names a column that holds the ``text_lines`` of the page already."""
    ks = _keys(pages, keys)
    keep = {**{k: F.col(k) for k in ks}, "_url": F.col(url), **({"_text": F.col(text)} if text else {})}
    lines = F.col("_text") if text else H.lines_in("_bare")
    step1 = cleaned(pages, keep, html, only_valid=True).select(
        *ks, "_url", "_nc", "_clean", H.hrefs_in("_bare").alias("_hrefs"), lines.alias("text"))
    step2 = step1.select(*ks, "text", "_nc", H.resolve_links("_url", "_hrefs", strip_base).alias("_r"), "_clean")
    step3 = step2.select(
        *ks, "text", F.col("_r.email").alias("email_links"),
        H.tag_internal("_r.resolved", "_r.sld").alias("_t"),
        F.regexp_extract_all("_clean", F.lit(H.VOID_ELEMENT_RE["images"]), 0).alias("images"),
        F.regexp_extract_all("_nc", F.lit(H.SCRIPT_ELEMENT_RE), 0).alias("scripts"),
        H.nested_elements("_clean", H.TABLE_TAG_RE).alias("tables"),
        F.regexp_extract_all("_clean", F.lit(H.VOID_ELEMENT_RE["metas"]), 0).alias("meta"),
        F.transform(F.regexp_extract_all("_clean", F.lit(H.TAG_NAME_RE), 1), lambda n: F.lower(n))
         .alias("html_tags"))
    return step3.select(*ks, "email_links", H.external_links("_t").alias("external_outlinks"), "images",
                        H.internal_links("_t").alias("internal_outlinks"), "meta", "text", "scripts", "tables",
                        "html_tags")


def feature_numbers(feature_lists: DataFrame, keys=("page_id",)) -> DataFrame:
    """List lengths of the nine features (integer feature vector)."""
    ks = _keys(feature_lists, keys)
    return feature_lists.select(*ks, *[F.size(f).alias(f) for f in FEATURES])

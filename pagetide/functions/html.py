"""Page-content extraction as native column expressions.

All patterns stay inside the subset that Java regex and RE2 share (no
look-around, no back-references), so that the same extraction can be checked
against an independent SQL engine.  Comments are removed first and
script/style bodies are blanked before any tag is looked at, because real pages
carry ``</p>`` or ``<a`` inside JavaScript strings.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions import urls

# Fixed patterns (shared with the SQL oracle in pagetide/plans/oracle.py).
COMMENT_RE = r"(?s)<!--.*?-->"
SCRIPT_STYLE_RE = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
SCRIPT_STYLE_BODY_RE = r"(?is)(<script\b[^>]*>).*?(</script\s*>)|(<style\b[^>]*>).*?(</style\s*>)"
HEAD_RE = r"(?is)<head\b[^>]*>.*?</head\s*>"
HREF_RE = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
TAG_NAME_RE = r"<([a-zA-Z][a-zA-Z0-9]*)"
HTML_ELEMENT_RE = r"(?i)<html[\s>/]"
# Block-level tags that end a line of text.
BLOCK_TAG_RE = (r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|td|th|table|thead|tbody|tfoot|section|article|"
                r"header|footer|nav|aside|main|blockquote|pre|hr|dl|dt|dd|form|fieldset|figure|"
                r"figcaption|address|title|option|caption|body|html)\b[^>]*>")
ANY_TAG_RE = r"(?s)<[^>]*>"
# Element patterns for the serialised element lists.
VOID_ELEMENT_RE = {
    "images": r"(?i)<img\b[^>]*>",
    "metas": r"(?i)<meta\b[^>]*>",
}
SCRIPT_ELEMENT_RE = r"(?is)<script\b[^>]*>.*?</script\s*>"
TABLE_OPEN_RE = r"(?i)<table(?:[\s/][^>]*)?>"
TABLE_TAG_RE = r"(?i)</?table(?:[\s/][^>]*)?>"

# The same matches as the patterns above, for Java: one test of '<' tells most places apart, where a pattern that ignores case
# throughout compares a whole word at every place.
_ANY_CASE = {
    "script_style": r"(?s)<(?:(?i:script\b[^>]*>.*?</script\s*>)|(?i:style\b[^>]*>.*?</style\s*>))",
    "script_style_body": r"(?s)<(?:(?i:(script\b[^>]*>).*?(</script\s*>))|(?i:(style\b[^>]*>).*?(</style\s*>)))",
    "head": r"(?s)<(?i:head\b[^>]*>.*?</head\s*>)",
    "href": r"""(?s)<(?i:a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))""",
}

# Fixed: the commonest named references, answered before the full table is searched.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", "\u00a0"), ("&amp;", "&")]
# Whitespace as Python's str.split / str.strip see it: ASCII space characters
# plus the Unicode space separators (no-break space included).
WS = r"[\s\p{Z}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Tokens of a text around character references (decimal, hex or named, ';' optional);
# everything else passes through unchanged.
ENTITY_TOKEN_RE = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&"
REPLACEMENT_CHAR = "\ufffd"
STAND_IN = "\ufdd0"  # a code point that is no character; strings that hold it are decoded token by token
# Names that need no semicolon, the longest first: such a name may be the start of a longer word.
OPEN_NAME_RE = "^&(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
# References to 128 ... 159 mean Windows-1252 characters; its unassigned places stay control characters.
WINDOWS_1252 = [bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)]


def replaced(text, find: str, new: str) -> Column:
    """``find`` replaced by ``new`` wherever it stands in a text: a literal pattern, which Java looks for in leaps, where
    ``replace`` compares at every byte."""
    return F.regexp_replace(_col(text), f"\\Q{find}\\E", new.replace("\\", "\\\\").replace("$", "\\$"))


def _code_point_char(n: Column) -> Column:
    """Character for a code point; invalid ones (0, surrogates, > U+10FFFF) give U+FFFD, most
    control characters and non-characters vanish."""
    valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    dropped = (n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF)
               | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    as_char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when(~F.coalesce(valid, F.lit(False)), F.lit(REPLACEMENT_CHAR))
             .when(n.between(128, 159), F.try_element_at(F.array(*[F.lit(c) for c in WINDOWS_1252]), (n - 127).cast("int")))
             .when(dropped, F.lit("")).otherwise(as_char))


def _by_first_letter() -> Column:
    """The table of names as a map of small maps, one literal: a look-up in a map of Spark's compares key after key."""
    table: dict[str, dict[str, str]] = {}
    for name, char in html5.items():
        table.setdefault(name[0], {})[name] = char
    return F.from_json(F.lit(json.dumps(table)), "map<string,map<string,string>>")


def unescape(s) -> Column:
    """Decode numeric and named character references in one pass (so an escaped
    ampersand never starts a second reference), as Python's ``html.unescape``.

    The commonest names are compared first and numbers are told by their ``#``; the table of names is asked for
    the rest, and names that need no semicolon only after a miss.
    """
    names = _by_first_letter()  # once in the expression: a literal of this size is costly to plan and to send
    open_names = F.from_json(F.lit(json.dumps({n: c for n, c in html5.items() if not n.endswith(";")})), "map<string,string>")

    def number(t):
        digits = F.regexp_extract(t, r"^&#([0-9]+);?$", 1)
        hexed = F.regexp_extract(t, r"^&#[xX]([0-9a-fA-F]+);?$", 1)
        return (F.when(digits != "", _code_point_char(digits.try_cast("long")))
                 .when(hexed != "", _code_point_char(F.conv(hexed, 16, 10).try_cast("long"))).otherwise(t))

    def by_start(t):
        return let(F.regexp_extract(t, OPEN_NAME_RE, 1),
                   lambda start: F.concat(F.try_element_at(open_names, start), t.substr(F.length(start) + 2, F.length(t))))

    def token(t):
        name = F.try_element_at(F.try_element_at(names, F.substring(t, 2, 1)), t.substr(F.lit(2), F.length(t)))
        return (F.when(~t.startswith("&"), t).when(t.startswith("&#"), number(t))
                 .otherwise(F.coalesce(name, by_start(t), t)))

    def decoded(x):
        # The commonest names by whole-string replacements.  None of them makes an ampersand but that of "&amp;", which stays a
        # stand-in until all else is decoded; and no name holds one of the characters they make, so names end where they did.
        y = replaced(x, "&amp;", STAND_IN)
        for entity, char in ENTITIES[:-1]:
            y = replaced(y, entity, char)
        plain = ~F.contains(x, F.lit(STAND_IN))
        rest = F.when(plain, y).otherwise(x)
        done = let(rest, lambda z: F.when(~F.contains(z, F.lit("&")), z).otherwise(
            F.array_join(F.transform(F.regexp_extract_all(z, F.lit(ENTITY_TOKEN_RE), 0), token), "")))
        return let(done, lambda z: F.when(plain, replaced(z, STAND_IN, "&")).otherwise(z))

    # Strings without '&' (most hrefs, many lines) are left as they are.
    return let(_col(s), lambda x: F.when(~F.contains(x, F.lit("&")), x).otherwise(decoded(x)))


def strip_ws(s) -> Column:
    """Python-style ``str.strip()``."""
    return F.regexp_replace(_col(s), f"^{WS}+|{WS}+$", "")


def without_comments(html) -> Column:
    return F.regexp_replace(_col(html), COMMENT_RE, "")


def without_scripts(html) -> Column:
    """Comments and whole script/style elements removed."""
    return scripts_out(without_comments(html))


def scripts_out(uncommented) -> Column:
    return F.regexp_replace(_col(uncommented), _ANY_CASE["script_style"], "")


def blank_script_bodies(html) -> Column:
    """Comments removed, script/style bodies emptied, their tags kept."""
    return script_bodies_out(without_comments(html))


def script_bodies_out(uncommented) -> Column:
    return F.regexp_replace(_col(uncommented), _ANY_CASE["script_style_body"], "<$1$2$3$4")


def hrefs(html) -> Column:
    """All ``<a href>`` values in document order, unquoted, entity-decoded and stripped."""
    return hrefs_in(without_scripts(html))


def hrefs_in(bare) -> Column:
    """``hrefs`` of a source without comments, scripts and styles."""
    raw = F.regexp_extract_all(_col(bare), F.lit(_ANY_CASE["href"]), 1)

    def unquote(v):
        quoted = v.startswith('"') | v.startswith("'")
        inner = F.when(quoted, v.substr(F.lit(2), F.length(v) - 2)).otherwise(v)
        return strip_ws(unescape(inner))

    return F.transform(raw, unquote)


def resolve_links(url, href_list, strip_base: bool = True) -> Column:
    """Struct of (e-mail hrefs, resolved other links, page second-level label).

    ``mailto:`` hrefs (case-sensitive prefix) are e-mail links; every other href
    is resolved against the page (``strip_base`` drops the page's protocol first).
    """
    current = urls.strip_protocol(url) if strip_base else _col(url)
    root = urls.root_domain(current)
    hs = _col(href_list)
    email = F.filter(hs, lambda h: h.startswith("mailto:"))
    resolved = F.transform(F.filter(hs, lambda h: ~h.startswith("mailto:")),
                           lambda h: urls.href_to_url(h, root, current))
    return F.struct(email.alias("email"), resolved.alias("resolved"), urls.sl_domain(current).alias("sld"))


def tag_internal(resolved, page_sld) -> Column:
    """Each resolved link with a flag: internal when its second-level label
    equals the page's.  Materialise this once, then split with
    ``internal_links`` / ``external_links``."""
    return F.transform(_col(resolved),
                       lambda u: F.struct(u.alias("u"), (urls.sl_domain(u) == _col(page_sld)).alias("i")))


def internal_links(tagged) -> Column:
    return F.transform(F.filter(_col(tagged), lambda t: t["i"]), lambda t: t["u"])


def external_links(tagged) -> Column:
    return F.transform(F.filter(_col(tagged), lambda t: ~t["i"]), lambda t: t["u"])


def tag_names(html) -> Column:
    """Lower-cased names of all start tags (comments removed, script/style bodies blanked)."""
    names = F.regexp_extract_all(blank_script_bodies(html), F.lit(TAG_NAME_RE), 1)
    return F.transform(names, lambda n: F.lower(n))


def let(value, fn) -> Column:
    """``fn`` of a value that is worked out once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def nested_elements(html, tag_re: str) -> Column:
    """Source text of every element of one kind, from its opening to its closing tag, nested ones included, in the order
    of their opening tags.

    ``tag_re`` finds the opening and closing tags.  A running sum over them gives every tag its depth; tags of one
    depth alternate between opening and closing, so after a sort by (depth, position) an element's end is
    the next entry.  A closing tag without an opening one is passed over; an element that is never closed ends with the page.
    """
    parts = F.struct(F.regexp_extract_all(_col(html), F.lit(tag_re), 0).alias("tags"), F.split(_col(html), tag_re, -1).alias("texts"))

    def closes(tag):
        return tag.startswith("</")

    def with_depths(p):
        depth = F.aggregate(p["tags"], F.array(F.lit(0)), lambda acc, t: F.concat(
            acc, F.array(F.greatest(F.element_at(acc, -1) + F.when(closes(t), -1).otherwise(1), F.lit(0)))))
        pieces = F.transform(p["tags"], lambda t, i: F.concat(t, F.get(p["texts"], i + 1)))
        return F.struct(p["tags"].alias("tags"), pieces.alias("pieces"), depth.alias("depth"))

    def with_levels(p):
        level = F.transform(p["tags"], lambda t, i: F.struct(
            F.greatest(F.get(p["depth"], i), F.get(p["depth"], i + 1)).alias("level"), i.alias("at"), closes(t).alias("end")))
        return F.struct(p["tags"].alias("tags"), p["pieces"].alias("pieces"),
                        F.array_sort(F.filter(level, lambda x: x["level"] > 0)).alias("ordered"))

    def elements(p):
        spans = F.transform(p["ordered"], lambda x, k: let(F.get(p["ordered"], k + 1), lambda y: F.struct(
            x["at"].alias("at"), F.when(y["level"] == x["level"], y["at"]).alias("stop"), x["end"].alias("end"))))
        opened = F.array_sort(F.filter(spans, lambda x: ~x["end"]))
        return F.transform(opened, lambda x: F.concat(
            F.array_join(F.slice(p["pieces"], x["at"] + 1, F.coalesce(x["stop"], F.size(p["tags"])) - x["at"]), ""),
            F.coalesce(F.get(p["tags"], x["stop"]), F.lit(""))))

    found = let(let(let(parts, with_depths), with_levels), elements)
    return F.when(F.regexp_like(_col(html), F.lit(tag_re)), found).otherwise(F.when(_col(html).isNotNull(), F.array().cast("array<string>")))


def element_list(html, kind: str) -> Column:
    """Serialised elements of one kind: ``images``, ``metas``, ``scripts``, ``tables``."""
    cleaned = blank_script_bodies(html)
    if kind in VOID_ELEMENT_RE:
        return F.regexp_extract_all(cleaned, F.lit(VOID_ELEMENT_RE[kind]), 0)
    if kind == "scripts":
        return F.regexp_extract_all(without_comments(html), F.lit(SCRIPT_ELEMENT_RE), 0)
    if kind == "tables":
        return nested_elements(cleaned, TABLE_TAG_RE)
    raise ValueError(f"unknown element kind {kind!r}")


def has_html_element(html) -> Column:
    return has_html_tag(blank_script_bodies(html))


def has_html_tag(clean) -> Column:
    """``has_html_element`` of a source without comments and script bodies."""
    return F.coalesce(F.regexp_like(_col(clean), F.lit(HTML_ELEMENT_RE)), F.lit(False))


def text_lines(html) -> Column:
    """Visible text as lines: head/script/style/comments dropped, block tags end a
    line, other tags vanish, character references decoded, lines stripped, blanks dropped."""
    return lines_in(without_scripts(html))


def lines_in(bare) -> Column:
    """``text_lines`` of a source without comments, scripts and styles."""
    body = F.regexp_replace(_col(bare), _ANY_CASE["head"], "")
    body = F.regexp_replace(body, BLOCK_TAG_RE, "\n")
    body = unescape(F.regexp_replace(body, ANY_TAG_RE, ""))
    lines = F.transform(F.split(body, r"\r?\n|\r"), lambda s: strip_ws(s))
    return F.filter(lines, lambda s: s != "")


def words(lines) -> Column:
    """Whitespace-separated words of a line array."""
    joined = F.array_join(_col(lines), " ")
    return F.filter(F.split(joined, f"{WS}+"), lambda w: w != "")


def one_line(lines) -> Column:
    """Lines joined and whitespace runs collapsed to one space."""
    return F.regexp_replace(strip_ws(F.array_join(_col(lines), "\n")), f"{WS}+", " ")

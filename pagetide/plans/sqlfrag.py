"""DuckDB SQL fragments mirroring the column functions, for the oracle queries.

Each helper returns an SQL expression string.  The tag patterns are the same
objects the Spark side uses, so both engines run identical patterns; what they
find is checked against ``html.parser`` in tests/test_html_stdlib.py.  Character
references are written here anew.
"""

from __future__ import annotations

import html.entities

from pagetide.functions import html as H


def q(s: str) -> str:
    """SQL string literal (backslashes are literal in DuckDB strings)."""
    return "'" + s.replace("'", "''") + "'"


def rx_replace(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def strip_ws(x: str) -> str:
    return rx_replace(x, f"^{H.WS}+|{H.WS}+$")


def _code_point_char(n: str) -> str:
    remapped = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160))
    return (f"(CASE WHEN {n} IS NULL OR {n} <= 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN chr(65533) "
            f"WHEN {n} BETWEEN 128 AND 159 THEN substr({q(remapped)}, CAST({n} - 127 AS INTEGER), 1) "
            f"WHEN {n} < 9 OR {n} = 11 OR {n} BETWEEN 14 AND 31 OR {n} = 127 OR {n} BETWEEN 64976 AND 65007 "
            f"OR {n} % 65536 >= 65534 THEN '' ELSE chr(CAST({n} AS INTEGER)) END)")


def _names() -> str:
    table = html.entities.html5
    return f"MAP([{', '.join(q(n) for n in table)}], [{', '.join(q(c) for c in table.values())}])"


_OPEN = "|".join(sorted((n for n in html.entities.html5 if n[-1] != ";"), key=len, reverse=True))


def unescape(x: str) -> str:
    dec = "TRY_CAST(regexp_extract(t, '^&#([0-9]+);?$', 1) AS BIGINT)"
    hx = "TRY_CAST(('0x' || regexp_extract(t, '^&#[xX]([0-9a-fA-F]+);?$', 1)) AS BIGINT)"
    start = f"regexp_extract(t, '^&({_OPEN})', 1)"
    searched = (f"coalesce(element_at({_names()}, substr(t, 2))[1], "
                f"element_at({_names()}, {start})[1] || substr(t, length({start}) + 2), t)")
    token = (f"CASE WHEN regexp_matches(t, '^&#[0-9]+;?$') THEN {_code_point_char(dec)} "
             f"WHEN regexp_matches(t, '^&#[xX][0-9a-fA-F]+;?$') THEN {_code_point_char(hx)} "
             f"WHEN t = '&amp;' THEN '&' WHEN NOT starts_with(t, '&') THEN t ELSE {searched} END")
    pieces = "'&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\\t\\n\\f <&#;]{1,32};?|[^&]+|&'"
    decoded = f"array_to_string(list_transform(regexp_extract_all({x}, {pieces}, 0), lambda t: {token}), '')"
    return f"(CASE WHEN instr({x}, '&') > 0 THEN {decoded} ELSE {x} END)"


def strip_protocol(x: str) -> str:
    return rx_replace(x, r"^(https?://)+")


def root_domain(x: str) -> str:
    return f"split_part({strip_protocol(x)}, '/', 1)"


def sl_domain(x: str) -> str:
    r = root_domain(x)
    return f"(CASE WHEN len(string_split({r}, '.')) >= 2 THEN string_split({r}, '.')[-2] ELSE {r} END)"


def without_comments(x: str) -> str:
    return rx_replace(x, H.COMMENT_RE)


def without_scripts(x: str) -> str:
    return rx_replace(without_comments(x), H.SCRIPT_STYLE_RE)


def blank_script_bodies(x: str) -> str:
    return rx_replace(without_comments(x), H.SCRIPT_STYLE_BODY_RE, r"\1\2\3\4")


def hrefs(x: str) -> str:
    raw = f"regexp_extract_all({without_scripts(x)}, {q(H.HREF_RE)}, 1)"
    unq = ("(CASE WHEN starts_with(v, '\"') OR starts_with(v, '''') THEN substr(v, 2, length(v) - 2) "
           "ELSE v END)")
    return f"list_transform({raw}, lambda v: {strip_ws(unescape(unq))})"


def href_to_url(h: str, root: str, cur: str) -> str:
    hh = rx_replace(h, "/+$")
    return (f"(CASE WHEN {hh} = '' THEN {cur} "
            f"WHEN starts_with({hh}, 'http://') OR starts_with({hh}, 'https://') THEN {strip_protocol(hh)} "
            f"WHEN starts_with({hh}, '/') THEN {root} || {hh} "
            f"ELSE {cur} || '/' || {hh} END)")


def text_lines(x: str) -> str:
    body = rx_replace(without_scripts(x), H.HEAD_RE)
    body = rx_replace(body, H.BLOCK_TAG_RE, "\n")
    body = unescape(rx_replace(body, H.ANY_TAG_RE))
    lines = f"list_transform(regexp_split_to_array({body}, {q(chr(13) + '?' + chr(10) + '|' + chr(13))}), lambda s: {strip_ws('s')})"
    return f"list_filter({lines}, lambda s: s <> '')"


def words(lines: str) -> str:
    return f"list_filter(regexp_split_to_array(array_to_string({lines}, ' '), {q(H.WS + '+')}), lambda w: w <> '')"


def one_line(lines: str) -> str:
    return rx_replace(strip_ws(f"array_to_string({lines}, chr(10))"), H.WS + "+", " ")


def tag_names(clean: str) -> str:
    return f"list_transform(regexp_extract_all({clean}, {q(H.TAG_NAME_RE)}, 1), lambda n: lower(n))"


def extract_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def has_html_element(x: str) -> str:
    return f"coalesce(regexp_matches({blank_script_bodies(x)}, {q(H.HTML_ELEMENT_RE)}), false)"


def link_host(x: str) -> str:
    return f"split_part(split_part(lower({strip_ws(x)}), '://', 2), '/', 1)"

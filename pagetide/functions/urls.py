"""URL helpers as Column -> Column functions (JVM-side, codegen friendly).

Every function here is a plain composition of ``pyspark.sql.functions``; they
work both on ordinary columns and on lambda variables inside ``transform``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_protocol(url) -> Column:
    """Remove every leading ``http://`` / ``https://`` (case-sensitive)."""
    return F.regexp_replace(_col(url), r"^(https?://)+", "")


def root_domain(url) -> Column:
    """Text before the first ``/`` once the protocol is gone (keeps port, ``?``, ``#``)."""
    return F.substring_index(strip_protocol(url), "/", 1)


def sl_domain(url) -> Column:
    """Second-last dot label of the root domain; the whole root for one-label hosts."""
    root = root_domain(url)
    labels = F.split(root, r"\.")
    return F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(root)


def url_subdir_depth(url) -> Column:
    """Number of path parts after the host (a trailing ``/`` counts one empty part)."""
    return F.size(F.split(strip_protocol(url), "/")) - 1


def url_subdomain_depth(url) -> Column:
    """Number of host labels before the last two."""
    return F.greatest(F.size(F.split(root_domain(url), r"\.")) - 2, F.lit(0))


def digit_count(s) -> Column:
    return F.length(F.regexp_replace(_col(s), r"[^\p{Nd}]", ""))


def special_char_count(s) -> Column:
    """Characters that are neither letters nor decimal digits."""
    return F.length(F.regexp_replace(_col(s), r"[\p{L}\p{Nd}]", ""))


def protocol_flag(url) -> Column:
    """1 for ``https`` (case-insensitive scheme), else 0."""
    return F.when(F.lower(F.substring_index(_col(url), "://", 1)) == "https", 1).otherwise(0)


def href_to_url(href, root, current) -> Column:
    """Resolve an href against the page: empty -> current page, absolute -> protocol
    stripped, ``/x`` -> root + href, anything else -> current + ``/`` + href."""
    h = F.regexp_replace(_col(href), "/+$", "")
    return (F.when(h == "", _col(current))
            .when(h.startswith("http://") | h.startswith("https://"), strip_protocol(h))
            .when(h.startswith("/"), F.concat(_col(root), h))
            .otherwise(F.concat(_col(current), F.lit("/"), h)))


def link_host(link) -> Column:
    """Host of a seed link: lower-cased, between the first ``://`` and the next ``/``."""
    stripped = F.regexp_replace(_col(link), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")  # Python str.strip()
    after = F.try_element_at(F.split(F.lower(stripped), "://"), F.lit(2))
    return F.substring_index(after, "/", 1)


def seed_sld(link) -> Column:
    """Seed-selection second-level domain: the last two labels of the host."""
    return F.substring_index(link_host(link), ".", -2)


def has_protocol_and_dot(url) -> Column:
    """A URL is usable when it has ``://`` and the part right after it contains a dot."""
    parts = F.split(_col(url), "://")
    return (F.size(parts) >= 2) & (F.instr(F.try_element_at(parts, F.lit(2)), ".") > 0)


def tld(link) -> Column:
    """Last label of the lower-cased host."""
    return F.substring_index(link_host(link), ".", -1)

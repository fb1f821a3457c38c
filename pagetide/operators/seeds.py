"""Seed-link selection: link extraction from dump lines, TLD and ranked-list
filters, per-domain limits with stage numbers, stage sizes, domain split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.functions import urls as U
from pagetide.operators.ordering import dense_index

# Fixed: a link follows one of these characters and runs until one of the
# terminators (group form of a look-behind; identical matches).
DUMP_LINK_RE = r"""["\[><;=\n ](http[^|"\]><;\n ]*)"""
SEED = "links"
SLD_LIMIT = 50


def dump_links(lines: DataFrame, line: str = "line", keys=("page_id", "line_no")) -> DataFrame:
    """(keys..., link_no, link): links of each dump line, entity-decoded first,
    kept when they have ``://`` and a dot right after it, one trailing ``/`` cut.
    Matching is per line, so a link at the very start of a line is not found."""
    ks = [k for k in keys if k in lines.columns]
    found = F.regexp_extract_all(H.unescape(line), F.lit(DUMP_LINK_RE), 1)
    valid = F.filter(found, lambda u: U.has_protocol_and_dot(u))
    cut = F.transform(valid, lambda u: F.when(u.endswith("/"), u.substr(F.lit(1), F.length(u) - 1)).otherwise(u))
    return lines.select(*ks, F.posexplode(cut).alias("link_no", "link"))


def tld_filter(links: DataFrame, tld: str, link: str = "link") -> DataFrame:
    """Links whose lower-cased host ends in the label ``tld``."""
    return links.filter(U.tld(link) == tld)


def ranked_domain_links(ranked: DataFrame, tld: str, domain: str = "domain", tld_col: str = "tld",
                        prefix: str = "http://") -> DataFrame:
    """Domains of a ranked list with the given TLD, as ``http://`` links."""
    return ranked.filter(F.col(tld_col) == tld).select(F.concat(F.lit(prefix), F.col(domain)).alias("link"))


def consider(links: DataFrame, probability: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample of the links (each kept with ``probability``)."""
    return links if probability >= 1 else links.sample(fraction=probability, seed=seed)


def link_popularity(links: DataFrame, link: str = "link") -> DataFrame:
    """(sld, link, n): occurrences of each link within its second-level domain;
    links without ``://`` or with a one-label host are dropped."""
    parsable = links.filter(F.size(F.split(U.link_host(link), r"\.")) >= 2)
    return (parsable.select(U.seed_sld(link).alias("sld"), F.col(link).alias("link"))
                    .groupBy("sld", "link").agg(F.count(F.lit(1)).alias("n")))


def limit_per_domain(links: DataFrame, limit: int = SLD_LIMIT, by_popularity: bool = False,
                     seed: str = SEED, link: str = "link") -> DataFrame:
    """(sld, stage, link[, n]): at most ``limit`` distinct links per domain.

    Random selection orders by a seeded hash, popularity by count (ties by
    link).  ``row_number() <= limit`` plans as a ``WindowGroupLimit``, so every
    task keeps only ``limit`` rows per domain before the shuffle: a domain
    holding a third of all links never reaches one task whole.
    """
    pop = link_popularity(links, link)
    if by_popularity:
        order = [F.desc("n"), F.col("link")]
    else:
        order = [F.md5(F.concat(F.lit(seed), F.col("link"))), F.col("link")]
    w = Window.partitionBy("sld").orderBy(*order)
    ranked = pop.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    cols = ["sld", (F.col("_rn") - 1).alias("stage"), "link"] + (["n"] if by_popularity else [])
    return ranked.select(*cols)


def stage_sizes(staged: DataFrame) -> DataFrame:
    """(stage, urls, percentage): links per stage and their share of the largest
    stage so far (running maximum), rounded to 2 places.  At most ``limit`` rows."""
    per = staged.groupBy("stage").agg(F.count(F.lit(1)).alias("urls"))
    run_max = F.max("urls").over(Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, 0))
    return per.select("stage", "urls", F.round(100.0 * F.col("urls") / run_max, 2).alias("percentage"))


def split_domains(first_stage: DataFrame, train_size: float, seed: int = 7, link: str = "link") -> DataFrame:
    """(sld, train): second-level labels of first-stage links split into a training
    share of floor(train_size * n) and the rest, in seeded-hash order."""
    slds = first_stage.select(U.sl_domain(link).alias("sld")).distinct()
    ranked = dense_index(slds, [], [F.md5(F.concat(F.lit(str(seed)), F.col("sld"))), F.col("sld")],
                         name="_pos", total="_n")
    return ranked.select("sld", (F.col("_pos") <= F.floor(F.col("_n") * F.lit(float(train_size)))).alias("train"))

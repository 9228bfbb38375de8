"""URL filters with an empirical-Bayes host reputation, in DataFrame operations alone.

Pages with labels are outcomes (bad: toxic or of low quality). The share of bad pages of each public suffix,
registered domain and host is a beta-binomial whose prior comes from the level above it: the mean from the
parent's posterior, the strength from the spread of the children (method of moments). A host's verdict is
`block` when the lower bound of its site's posterior share of bad pages exceeds a threshold. Path rules go before it.

Outcomes are counted for sites: a host without a user name before it and a port after it. Its public suffix is the last
label, or the last two where they are in a table (an input; SUFFIXES is a short one), its registered domain has one label
more. A host that is an IP number is its own domain, under no suffix.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is judged by the
reputation of all pages; a host never labelled has its domain's, else its suffix's, else the overall posterior;
repeated pages count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Normal quantile of the bound, share of bad pages above which a host is blocked, and the limits of a prior's strength.
Z, BLOCK_ABOVE, LEAST_STRENGTH, MOST_STRENGTH = 1.645, 0.35, 2.0, 1000.0
LEVELS = ("suffix", "domain", "site")
#: Public suffixes of two labels, where one label would take in a whole country's sites.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.tw", "com.hk", "com.sg", "com.my",
    "ac.in", "co.in", "gov.in", "net.in", "org.in", "co.id", "co.th", "com.ph", "com.vn", "com.br", "gov.br", "net.br", "org.br", "com.ar", "com.mx", "com.co", "com.pe",
    "ac.za", "co.za", "gov.za", "org.za", "co.ke", "com.ng", "com.eg", "com.tr", "gov.tr", "ac.il", "co.il", "org.il", "com.sa", "com.ua", "com.pl", "github.io", "blogspot.com",
)
USER, PORT, NUMBER = "^.*@", ":[0-9]*$", r"^([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+|\[.*\])$"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_parts(pages: DataFrame, suffixes: tuple = SUFFIXES) -> DataFrame:
    """(page_id, host, path, site, domain, suffix)."""
    host, path = url_parts(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    split = split.withColumn("site", F.regexp_replace(F.regexp_replace("host", USER, ""), PORT, ""))
    number, last = F.col("site").rlike(NUMBER), lambda n: F.substring_index("site", ".", -n)
    long = last(2).isin(*suffixes)
    domain = F.when(number, F.col("site")).when(long, last(3)).otherwise(last(2))
    return split.withColumns({"domain": domain, "suffix": F.when(number, "").when(long, last(2)).otherwise(last(1))})


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def outcome_counts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(site, domain, suffix, n, bad) over the labelled pages; counts of sites, so no row-level join goes further up.
    Written once, as every level reads them."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("page_id"), bad.cast("int").alias("bad"))
    marks = marks.groupBy("page_id").agg(F.max("bad").alias("bad"))
    joined = with_parts(pages).join(marks.hint("shuffle_hash"), "page_id")
    counts = joined.groupBy("site", "domain", "suffix").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    return written(counts, "outcomes")


def strength(rates: DataFrame, child: str, parent: str | None) -> DataFrame:
    """One row per parent: a prior strength from the children's spread. With mean m and variance v of the children's
    shares, a beta distribution has strength m(1-m)/v - 1."""
    share = F.col("bad") / F.col("n")
    m, v = F.avg(share), F.var_pop(share)
    fit = F.when(v > 0, m * (1 - m) / v - 1).otherwise(MOST_STRENGTH)
    bounded = F.least(F.greatest(fit, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)).alias("strength")
    return rates.groupBy(*([parent] if parent else [])).agg(bounded)


def posteriors(counts: DataFrame) -> dict[str, DataFrame]:
    """Beta posteriors (a, b) by level, from all pages down to sites."""
    top = counts.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"))
    out = {"all": top.select((F.col("bad") + 1).alias("a"), (F.col("n") - F.col("bad") + 1).alias("b"))}
    parent = None
    for level in LEVELS:
        keys = [*([parent] if parent else []), level]
        rates = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        above = out[parent or "all"].withColumnRenamed("a", "pa").withColumnRenamed("b", "pb")
        wide = rates.join(strength(rates, level, parent).hint("shuffle_hash"), parent) if parent else rates.join(F.broadcast(strength(rates, level, None)))
        # without a parent both are one aggregated row each
        wide = wide.join(above.hint("shuffle_hash"), parent) if parent else wide.join(F.broadcast(above))
        mean = F.col("pa") / (F.col("pa") + F.col("pb"))
        out[level] = written(wide.select(level, (mean * F.col("strength") + F.col("bad")).alias("a"), ((1 - mean) * F.col("strength") + F.col("n") - F.col("bad")).alias("b")), f"posteriors-{level}")
        parent = level
    return out


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    mean = a / (a + b)
    return mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def site_reputation(sites: DataFrame, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(site, share_bad, bound) for every site of (site, domain, suffix) rows, labelled or not."""
    post = posteriors(outcome_counts(pages, labels))
    found = sites.select("site", "domain", "suffix").distinct()
    for level in reversed(LEVELS):
        found = found.join(post[level].select(level, F.col("a").alias(f"a_{level}"), F.col("b").alias(f"b_{level}")).hint("shuffle_hash"), level, "left")
    found = found.join(F.broadcast(post["all"]))  # one row
    a = F.coalesce(*(f"a_{x}" for x in reversed(LEVELS)), "a")
    b = F.coalesce(*(f"b_{x}" for x in reversed(LEVELS)), "b")
    return found.select("site", (a / (a + b)).alias("share_bad"), lower_bound(a, b).alias("bound"))


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, block_above: float = BLOCK_ABOVE) -> DataFrame:
    """(page_id, host, path, rule, verdict, share_bad, bound) for every page."""
    parts = with_parts(pages)
    known = written(site_reputation(parts, pages, labels), "reputations")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    joined = parts.join(known.hint("merge"), "site", "left")
    own = F.when(F.col("bound") > block_above, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("share_bad", 6).alias("share_bad"), F.round("bound", 6).alias("bound"))

"""URL filter: literal rules first, then empirical-Bayes host reputation.

Method. Every labelled page is one Bernoulli outcome (1 good, 0 bad) of its
host. Outcomes are counted per host, registered domain and suffix by grouped
aggregation. Rates shrink from the top down: the suffix's posterior mean uses
the global rate as a beta prior of ``strength`` pseudo-pages, the registered
domain's uses its suffix's mean, the host's its domain's. The host's beta
posterior has mean m and variance m(1-m)/(a+b+1); the host is blocked where
m + z * sd < min_good, that is only where the data prove it bad. Hosts without
labels inherit the posterior of the nearest level that has any.

Everything is DataFrame expressions. The host level is aggregated before any
join, so a host that holds a third of all pages costs one row per task in the
shuffle; the join back to pages is on the host with adaptive skew splitting.

Defined results: null url or one without ``://``: empty host and path, no rule
fits, and the verdict is the method's for the empty host. Repeated pages keep
one row each. Outcomes that are null or not 0/1, or of unknown pages, count
nothing. Very long urls are read whole. Empty tables give empty results; with no outcomes all is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velora.llm.common import lower_ascii


@dataclass(frozen=True)
class Rule:
    """verdict for a host, with all its subdomains, where the path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else nulls.

    Equally long rules: the alphabetically first text, then block before allow.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict == "allow"), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


#: Labels under which countries register, as in co.uk. Fixed values, as is usual; a list of all suffixes would be a table of its own.
SECOND_LEVEL = "ac|co|com|edu|go|gov|ne|net|or|org"
_COUNTRY = rf"(^|[.])({SECOND_LEVEL})[.][a-z][a-z]$"
_ADDRESS = r"^([0-9]{1,3}([.][0-9]{1,3}){3}|\[.*\])$"


def levels(host: Column) -> dict[str, Column]:
    """Registered domain and suffix of a host, without user name and port.

    The last two labels and the last one; under a country's second level the last
    three and the last two. An address is a domain by itself, with the suffix "ip".
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    address, country = name.rlike(_ADDRESS), name.rlike(_COUNTRY)
    domain = F.when(address, name).when(country, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    suffix = F.when(address, F.lit("ip")).when(country, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return {"domain": domain, "suffix": suffix}


def reputation(hosts: DataFrame, strength: float = 8.0, z: float = 1.645) -> DataFrame:
    """Posterior of every host of ``hosts(host, n, good)``: host, mean, upper."""
    counted = hosts.withColumns(levels(F.col("host")))
    suffixes = counted.groupBy("suffix").agg(F.sum("n").alias("n_s"), F.sum("good").alias("g_s"))
    domains = counted.groupBy("domain", "suffix").agg(F.sum("n").alias("n_d"), F.sum("good").alias("g_d"))
    total = counted.agg(F.sum("n").alias("n_0"), F.sum("good").alias("g_0"))
    shrunk = lambda good, n, prior: (good + strength * prior) / (n + strength)
    # one row, so a nested-loop join with it is a projection
    suffixes = suffixes.join(F.broadcast(total)).select("suffix", shrunk(F.col("g_s"), F.col("n_s"), (F.coalesce("g_0", F.lit(0)) + 1.0) / (F.coalesce("n_0", F.lit(0)) + 1.0)).alias("m_s"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("g_d"), F.col("n_d"), F.col("m_s")).alias("m_d"))
    mean = shrunk(F.col("good"), F.col("n"), F.col("m_d"))
    return counted.join(domains, "domain").select("host", mean.alias("mean"), (mean + z * F.sqrt(mean * (1 - mean) / (F.col("n") + strength + 1))).alias("upper"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    *,
    min_good: float = 0.5,
    strength: float = 8.0,
    z: float = 1.645,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, reputation.

    outcomes(page_id, good) has the labelled pages. reputation is the upper
    bound of the host's posterior, rounded to 6 digits.
    """
    url = F.col("url")
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    good = F.col("good").cast("int")
    known = outcomes.select(F.col("page_id").alias("labelled"), good.alias("good")).where(good.isin(0, 1)).groupBy("labelled").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = parts.join(known, parts.page_id == known.labelled, "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    rated = reputation(hosts, strength, z).withColumnRenamed("host", "rated_host")
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("upper") < min_good, "block").otherwise("allow")
    return parts.join(rated, parts.host == rated.rated_host, "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, method).alias("verdict"), F.round("upper", 6).alias("reputation"))

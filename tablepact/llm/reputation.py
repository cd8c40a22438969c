"""Verdicts on urls: stated rules first, else the reputation of the host.

A host's share of bad pages is estimated by empirical Bayes. The outcomes of labelled
pages are counted by host, registered domain and public suffix. Every level has a
beta-binomial prior: its mean is the posterior mean of the level above, its strength
follows from how much the groups of that level differ beyond chance (moments of the
beta-binomial distribution) and from how well the mean above is known: the variances
add up. So a host with few labels is shrunk to its domain, a domain
to its suffix, a suffix to all pages. A host is blocked if its posterior gives at least
``Limits.confidence`` to a share of bad pages above ``Limits.most_bad``.

Labels are counted per host before anything is joined, so a host that holds a third of
all pages is one row per task. Domains and suffixes are sums of hosts. Only three
strengths and an overall mean reach the driver.

Edge cases: a url that is null or has no ``://`` has an empty host and path; all these
are one host. A page whose outcome is null counts for nothing. Repeated pages count as
often as they occur. Without any labels every host has the same even prior, and only
rules block. Hosts that are addresses, or one label, are their own domain. Of two rules
of equal length the one with the longer host wins, then the first in order of text.
Further columns of the input are kept; the added ones get free names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import free_name, materialized

# Suffixes of two labels under which anybody can register a name.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.cn",
    "com.hk", "com.mx", "com.tr", "com.tw", "co.in", "co.za", "com.ar", "com.sg",
)


@dataclass(frozen=True)
class Limits:
    """``most_bad``: the share of bad pages a host may have; ``confidence``: the posterior
    probability of more from which a host is blocked; ``spread``: the correlation of a
    group's outcomes where the labels do not tell it, and its least and largest value."""

    most_bad: float = 0.5
    confidence: float = 0.95
    spread: tuple[float, float, float] = (0.1, 1e-4, 0.9)


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and the beginning of a path, such as ``example.org/es/``."""

    verdict: str
    text: str

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block") or "/" not in self.text.lstrip("/"):
            raise ValueError(f"a rule is allow or block, and a host with a path, not {self.verdict} {self.text!r}")

    def fits(self, host: Column, path: Column) -> Column:
        own, _, begin = self.text.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith("/" + begin)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash; A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark or hash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain; a port and a last dot do not count."""
    name = F.regexp_replace(host, r"\.?(:[0-9]*)?$", "")
    labels = F.size(F.split(name, "[.]"))
    address = name.rlike(r"^[0-9.]+$|[\[\]:]")
    long = F.substring_index(name, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(address, name).when(long, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address | (labels < 2), name).when(long, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return suffix, domain


def beta_cdf(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction in Lentz's form."""
    a, b = (np.asarray(v, np.float64) for v in (a, b))
    swap = x > (a + 1) / (a + b + 2)  # the fraction converges fast below the mean
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(p), 1 / _away(1 - (p + q) * z / (p + 1), tiny)
    value, m = d.copy(), 0
    while True:
        m += 1
        for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / _away(1 + term * d, tiny)
            c = _away(1 + term / c, tiny)
            value *= c * d
        if not len(value) or np.abs(c * d - 1).max() < 1e-14:
            break
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    return np.where(swap, 1 - front * value, front * value)


def _away(v: np.ndarray, tiny: float) -> np.ndarray:
    return np.where(np.abs(v) < tiny, tiny, v)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series from 15 on, and the recurrence below."""
    below, shift = np.zeros_like(x), x.copy()
    for _ in range(15):
        low = shift < 15
        below, shift = below + np.where(low, np.log(np.where(low, shift, 1)), 0), np.where(low, shift + 1, shift)
    r = 1 / (shift * shift)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / shift
    return (shift - 0.5) * np.log(shift) - shift + 0.5 * np.log(2 * np.pi) + series - below


def _strength(groups: DataFrame, mean: Column, limits: Limits) -> float:
    """Of a level's prior: the outcomes a parent's mean is worth, by the moments of its groups."""
    usual, least, most = limits.spread
    n, bad = F.col("n_labelled").cast("double"), F.col("n_bad")
    seen = groups.where("n_labelled > 0").agg(
        F.sum(n * (bad / n - mean) * (bad / n - mean) / (mean * (1 - mean))), F.count(F.lit(1)), F.sum(n - 1)).first()
    excess, count, free = seen[0] or 0.0, seen[1], seen[2] or 0.0
    spread = min(most, max(least, (excess - count) / free)) if free > 0 else usual
    return 1 / spread - 1


def reputations(pages: DataFrame, *, url: str = "url", outcome: str = "bad", limits: Limits = Limits()) -> DataFrame:
    """A row per host: ``host, domain, suffix, n_pages, n_labelled, n_bad, mean, p_above``.

    ``outcome`` is true for a bad page, false for a good one, null for one without a label.
    ``mean`` is the posterior mean of the host's share of bad pages, ``p_above`` the
    posterior probability that it is above ``limits.most_bad``.
    """
    counts = [F.count("bad").alias("n_labelled"), F.count_if("bad").alias("n_bad")]
    hosts = pages.select(host_of(F.col(url)).alias("host"), F.col(outcome).alias("bad")).groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), *counts)
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = materialized(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    sums = [F.sum("n_labelled").alias("n_labelled"), F.sum("n_bad").alias("n_bad")]
    total = hosts.agg(*sums).first()
    weight = (total.n_labelled or 0) + 1
    overall = ((total.n_bad or 0) + 0.5) / weight

    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumns({"above": F.lit(overall), "weight": F.lit(float(weight))})

    def shrunk(groups: DataFrame) -> tuple[Column, Column]:
        """Posterior parameters of each group; the parent's have the mean ``above`` and the sum ``weight``."""
        strength = 1 / (F.lit(1 / (_strength(groups, F.col("above"), limits) + 1)) + 1 / (F.col("weight") + 1)) - 1
        return strength * F.col("above") + F.col("n_bad"), strength * (1 - F.col("above")) + F.col("n_labelled") - F.col("n_bad")

    def below(parents: DataFrame, children: DataFrame, on: str) -> DataFrame:
        a, b = shrunk(parents)
        means = materialized(parents.select(on, (a / (a + b)).alias("above"), (a + b).alias("weight")), f"mean-by-{on}")
        return children.join(means, on)

    hosts = below(below(suffixes, domains, "suffix"), hosts, "domain")
    a, b = shrunk(hosts)
    hosts = hosts.select("host", "domain", "suffix", "n_pages", "n_labelled", "n_bad", a.alias("a"), b.alias("b"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            above = 1 - beta_cdf(limits.most_bad, rows.a.to_numpy(), rows.b.to_numpy())
            yield rows.assign(mean=rows.a / (rows.a + rows.b), p_above=above).drop(columns=["a", "b"])

    return hosts.mapInPandas(measure, "host string, domain string, suffix string, n_pages bigint, n_labelled bigint, n_bad bigint, mean double, p_above double")


def judged_urls(pages: DataFrame, rules: Sequence[Rule] = (), *, url: str = "url", outcome: str = "bad",
                limits: Limits = Limits()) -> tuple[DataFrame, str]:
    """The pages with a struct of ``host, path, rule, verdict, n_labelled, n_bad, mean, p_above``; and its name.

    Rules become one expression, so they should be some hundred at most.
    """
    found = materialized(reputations(pages, url=url, outcome=outcome, limits=limits), "reputations")
    into, own = free_name(pages, "judged"), free_name(pages, "_host")
    host, path = F.col(own), path_of(F.col(url))
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.text.partition("/")[0]), r.text))
    fitting = F.coalesce(*[F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))) for r in ordered],
                         F.lit(None).cast("struct<text:string,verdict:string>"))
    blocked = F.col("p_above") >= limits.confidence
    joined = pages.withColumn(own, host_of(F.col(url))).join(found.select(F.struct("n_labelled", "n_bad", "mean", "p_above", blocked.alias("blocked")).alias("_r"), F.col("host").alias("_of")),
                                                          F.col(own) == F.col("_of"), "left")
    rated = F.col("_r")
    return joined.select(*[pages[c] for c in pages.columns], F.struct(
        host.alias("host"), path.alias("path"), fitting["text"].alias("rule"),
        F.coalesce(fitting["verdict"], F.when(rated["blocked"], "block").otherwise("allow")).alias("verdict"),
        *[rated[c].alias(c) for c in ("n_labelled", "n_bad", "mean", "p_above")]).alias(into)), into

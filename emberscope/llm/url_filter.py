"""URL filter: fixed rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes (``page_outcome``, or the caller's) are counted by host, registered domain and
public suffix; rules never label a page.  Each level is a beta-binomial: a suffix's rate of bad pages
varies around the overall one, a domain's around its suffix's, a host's around its domain's.  How much it
does is fitted for each level, by moments, to all outcomes (``concentration``).  A prior leaves out
the counts that it is the prior of: a host's comes from the domain's other hosts, a domain's from the
suffix's other domains, a suffix's from the other suffixes, so no outcome counts twice.  A page
is blocked if the ``LOWER`` quantile of its host's beta posterior is over ``LIMIT``: few outcomes widen the
posterior, so little evidence blocks nothing.

The registered domain is the suffix and one label more.  The suffix is the last label, or the last two where
a two-letter country code follows one of ``SECOND``.  User names and ports play no part; an IP address is
its own domain and suffix.

Pages are summed by host first.  What is looked up by host, domain or suffix for more than a
``PARTS``-th of all rows (so ``PARTS`` keys at most) is broadcast; the rest is joined, and there no key is hot.

Null URLs and those without ``://`` have an empty host and path.  A page without an outcome counts for
nothing.  Repeated rows each count and get their verdict.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import UPPER, checkpointed, looked_up, merge, tidy

LOWER, LIMIT, PARTS = 0.05, 0.5, 1000
#: Least and largest concentration: pages that a prior is worth.
WEAK, STRONG = 1.0, 1000.0
#: A page whose body has fewer words is bad, and so is one whose host has one of the names among its parts.
WORDS, NAMES = 50, ("adult", "bets", "casino", "pills", "porn", "spam", "xxx")
MARKUP = "(?is)<(?:script|style|head|nav|footer)[^>]*>.*?</(?:script|style|head|nav|footer)>|<!--.*?-->|<[^>]*>"
WORD = r"[^\x20\x09-\x0D]+"
#: Labels that form a suffix with a country code.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = r.fits(host, path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def page_outcome(url: Column, html: Column) -> Column:
    """True for a bad page: one of ``NAMES`` in its host, or a body of under ``WORDS`` words; null for a page without a body otherwise."""
    named = F.arrays_overlap(F.split(host_of(url), "[^a-z0-9]+"), F.array(*map(F.lit, NAMES)))
    thin = F.regexp_count(F.regexp_replace(html, MARKUP, " "), F.lit(WORD)) < WORDS
    return F.when(named, True).otherwise(thin)


def server(host: Column) -> Column:
    """The host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"


def suffix_of(host: Column) -> Column:
    name = server(host)
    last, two = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    country = two.rlike(rf"^({'|'.join(SECOND)})\.[a-z][a-z]$")
    return F.when(name.rlike(ADDRESS), name).when(country, two).otherwise(last)


def domain_of(host: Column) -> Column:
    name, suffix = server(host), suffix_of(host)
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(suffix == name, name).when(labels == 3, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def concentration(rows: DataFrame, n: str, bad: str, rate: str) -> float:
    """How many pages a level's prior is worth: of rows with counts and the rates expected of them.

    The variance of ``bad`` is n * r * (1 - r) * (1 + (n - 1) * rho); rho is fitted by moments to all rows, and the
    concentration is 1 / rho - 1, from WEAK to STRONG.
    """
    c, of = F.col(bad) - F.col(n) * F.col(rate), F.col(n) * F.col(rate) * (1 - F.col(rate))
    extra, room = rows.agg(F.sum(c * c - of).alias("extra"), F.sum((F.col(n) - 1) * of).alias("room")).first()
    rho = extra / room if room else 0.0
    return min(STRONG, max(WEAK, 1 / rho - 1)) if rho > 0 else STRONG


def reputation(hosts: DataFrame) -> DataFrame:
    """``hosts`` (host, rows, n, bad) with alpha and beta of each host's posterior rate of bad pages."""
    h = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = h.groupBy("domain", "suffix").agg(F.count("*").alias("rows"), F.sum("n").alias("n_d"), F.sum("bad").alias("bad_d"))
    suffixes = domains.groupBy("suffix").agg(F.count("*").alias("rows"), F.sum("n_d").alias("n_s"), F.sum("bad_d").alias("bad_s"))
    all_n, all_bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()

    def shrunk(n: str, bad: str, n_own: str, bad_own: str, k: float, prior: str) -> Column:
        """Rate of a level without one member's counts."""
        return (F.col(bad) - F.col(bad_own) + k * F.col(prior)) / (F.col(n) - F.col(n_own) + k)

    s = suffixes.withColumn("rate_0", (F.lit(all_bad) - F.col("bad_s") + 1) / (F.lit(all_n) - F.col("n_s") + 2))
    k_s = concentration(s, "n_s", "bad_s", "rate_0")
    d = looked_up(domains.drop("rows"), "suffix", s, "domain", PARTS)
    d = checkpointed(d.withColumn("rate_s", shrunk("n_s", "bad_s", "n_d", "bad_d", k_s, "rate_0")))
    k_d = concentration(d, "n_d", "bad_d", "rate_s")
    sizes = h.groupBy("domain").agg(F.count("*").alias("rows"))
    d = sizes.join(merge(d.select(F.col("domain").alias("_d"), "n_d", "bad_d", "rate_s")), F.col("domain") == F.col("_d")).drop("_d")
    h = looked_up(h.drop("rows"), "domain", d, "host", PARTS)
    h = checkpointed(h.withColumn("rate_d", shrunk("n_d", "bad_d", "n", "bad", k_d, "rate_s")))
    k_h = concentration(h, "n", "bad", "rate_d")
    return h.select("host", (F.col("bad") + k_h * F.col("rate_d")).alias("alpha"), (F.col("n") - F.col("bad") + k_h * (1 - F.col("rate_d"))).alias("beta"))


def beta_quantiles(alpha: np.ndarray, beta: np.ndarray, p: float, steps: int = 4000) -> np.ndarray:
    """Quantiles of beta distributions, by the density of the logit over a grid that holds all but 1e-15 of it."""
    out = np.empty(len(alpha))
    for i, (a, b) in enumerate(zip(alpha, beta)):
        mode, spread = np.log(a / b), np.sqrt(1 / a + 1 / b)
        u = np.linspace(mode - max(12 * spread, 40 / a), mode + max(12 * spread, 40 / b), steps)
        log_density = a * u - (a + b) * np.logaddexp(0, u)
        mass = np.exp(log_density - log_density.max())
        sums = np.concatenate([[0.0], np.cumsum((mass[1:] + mass[:-1]) / 2)])
        out[i] = 1 / (1 + np.exp(-np.interp(p * sums[-1], sums, u)))
    return out


def bounded(batches):
    """Over Arrow batches of (host, alpha, beta): (host, bound)."""
    import pyarrow as pa

    for batch in batches:
        bound = beta_quantiles(batch.column("alpha").to_numpy(), batch.column("beta").to_numpy(), LOWER)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(bound, pa.float64())], ["host", "bound"])


def judge(pages: DataFrame, url: str = "url", outcome: Column | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and, where no rule fits, the posterior's ``bound``.

    ``outcome`` is a page's label: true for a bad page, null for none; by default ``page_outcome``
    of its URL and column ``html``.  Columns of ``pages`` with the names of new ones are replaced; others may have any name.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "bound")]
    bad = page_outcome(pages[url], pages["html"]) if outcome is None else outcome
    # The sums by host read only the URL and what the outcome needs.
    labelled = pages.select(host_of(pages[url]).alias("host"), bad.alias("_bad"))
    hosts = labelled.groupBy("host").agg(F.count("*").alias("rows"), F.count("_bad").alias("n"), F.coalesce(F.sum(F.col("_bad").cast("long")), F.lit(0)).alias("bad"))
    hosts = checkpointed(hosts)
    bounds = reputation(hosts).mapInArrow(tidy(bounded), "host string, bound double").withColumnRenamed("host", "_h")
    bounds = checkpointed(hosts.join(merge(bounds), F.col("host") == F.col("_h")).select("host", "rows", "bound"))
    at = pages.select(*[pages[c].alias(f"_c{i}") for i, c in enumerate(names)], pages[url].alias("_url"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    at = at.withColumn("rule", name).withColumn("_verdict", verdict).withColumn("_row", F.monotonically_increasing_id())
    out = looked_up(at, "host", bounds, "_row", PARTS)
    verdict = F.coalesce("_verdict", F.when(F.col("bound") > LIMIT, "block").otherwise("allow"))
    bound = F.when(F.col("_verdict").isNull(), F.col("bound"))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], "host", "path", "rule", verdict.alias("verdict"), bound.alias("bound"))

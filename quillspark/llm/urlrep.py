"""Operator 8: URL filters by empirical-Bayes host reputation, with DataFrame functions only.

Labelled page outcomes (1: bad) are counted by host. Each level is shrunk towards the one above by a beta prior: a
suffix towards the rate of all labelled pages, a registered domain towards its suffix, a host towards its domain. The
strength of each prior is estimated over all groups of its level by moments. A host is blocked if, with probability
`confidence` under its posterior (a beta distribution, integrated), its odds of a bad page are over `lift` times those of all
labelled pages; that is, if that quantile's lower bound of its bad rate is over the limit.

Pages are counted by host with map-side combine, so a host with a third of all pages costs one row a task; verdicts of
hosts are joined back by an equi-join that adaptive execution can split. Only the sums of a level (one row) reach the
driver. Rules come first: the longest that fits wins.

Defined results: a null url, or one without `://`, has empty host and path; hosts without labelled pages fall back on
their domain; user names, ports and final dots of a host do not count for its reputation; an address is a domain of its own
under one common suffix; repeated rows are judged alike, and count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, materialize

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path."""
    safe = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(safe, _URL, 1)), F.regexp_extract(safe, _URL, 2)


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together), and its verdict; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


#: Second-level labels below which two-letter suffixes register domains: a.co.uk, a.com.au.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")


def reputation_site(host: Column) -> Column:
    """The host without user name, port and final dots."""
    for pattern in ("^.*@", ":[0-9]*$", "\\.+$"):
        host = F.regexp_replace(host, pattern, "")
    return host


def domain_and_suffix(site: Column) -> tuple[Column, Column]:
    """Registered domain, and the suffix under which it is registered."""
    address = site.rlike("^([0-9.]+|\\[.*\\])$")
    long = site.rlike(f"[^.]\\.({'|'.join(SECOND_LEVEL)})\\.[a-z][a-z]$")
    last = lambda n: F.substring_index(site, ".", -n)
    return F.when(address, site).when(long, last(3)).otherwise(last(2)), F.when(address, "[]").when(long, last(2)).otherwise(last(1))


def _strength(groups: DataFrame) -> float:
    """Prior weight from (n, bad, prior mean m): groups vary by rho * m * (1 - m) beyond chance, and weight = 1 / rho - 1."""
    m, n, p = F.col("m"), F.col("n"), F.col("bad") / F.col("n")
    row = groups.filter("n > 0").agg(F.sum(n * (p - m) * (p - m)).alias("seen"), F.sum(m * (1 - m)).alias("chance"), F.sum((n - 1) * m * (1 - m)).alias("room")).first()
    if not row["room"]:
        return 20.0
    rho = min(0.99, max(0.001, (row["seen"] - row["chance"]) / row["room"]))
    return 1.0 / rho - 1.0


#: Intervals of each of the two integrals of a posterior (Simpson's rule; an even number).
INTERVALS = 200


def with_tail(frame: DataFrame, limit: float) -> DataFrame:
    """Add `tail`, the probability that a beta variable with the frame's `a` and `b` is over `limit`.

    In u = logit(x) the density is log-concave: exp(a * u - (a + b) * log(1 + exp(u))). It is integrated from `left` to the
    limit and from there to `right`; beyond them it is an exponential, added as such, or nothing.
    """
    a, b, t = F.col("a"), F.col("b"), math.log(limit / (1 - limit))
    wide = 9 / F.sqrt(a * b / (a + b))
    frame = frame.withColumn("mode", F.log(a / b))
    frame = frame.withColumns({
        "left": F.least(F.lit(t), F.greatest(-F.log(a + b + 1) - 20, F.col("mode") - 40 / a - wide)),
        "right": F.greatest(F.lit(t), F.least(F.log(a + b + 1) + 20, F.col("mode") + 40 / b + wide)),
    })
    softplus = lambda u: F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u)))
    log_density = lambda u: a * u - (a + b) * softplus(u)
    frame = frame.withColumn("peak", log_density(F.col("mode")))
    density = lambda u: F.exp(log_density(u) - F.col("peak"))

    def integral(start: Column, end: Column) -> Column:
        step = (end - start) / INTERVALS
        weight = lambda i: F.when((i == 0) | (i == INTERVALS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        total = F.aggregate(F.sequence(F.lit(0), F.lit(INTERVALS)), F.lit(0.0), lambda s, i: s + weight(i) * density(start + i * step))
        return total * step / 3

    frame = frame.withColumn("below", integral(F.col("left"), F.lit(t)) + density(F.col("left")) / a)
    frame = frame.withColumn("above", integral(F.lit(t), F.col("right")) + density(F.col("right")) / b)
    return frame.withColumn("tail", F.col("above") / (F.col("above") + F.col("below"))).drop("mode", "left", "right", "peak", "below", "above")


def host_reputation(outcomes: DataFrame, lift: float = 2.0, confidence: float = 0.95) -> DataFrame:
    """From (site, bad: 0, 1 or null) the posterior of each site: site, n, rate (its mean), tail, blocked."""
    domain, suffix = domain_and_suffix(F.col("site"))
    hosts = materialize(outcomes.groupBy("site").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("bad")).first()
    overall = ((total[1] or 0) + 1.0) / ((total[0] or 0) + 2.0)
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("m", F.lit(overall))
    k = _strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("bad") + k * F.col("m")) / (F.col("n") + k)).alias("m"))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix"), "domains")
    k = _strength(domains)
    domains = domains.select("domain", "suffix", ((F.col("bad") + k * F.col("m")) / (F.col("n") + k)).alias("m"))
    placed = materialize(hosts.join(domains, ["domain", "suffix"]), "placed")
    k = _strength(placed)
    odds = lift * overall / (1 - overall)
    posterior = placed.select("site", "n", (F.col("bad") + k * F.col("m")).alias("a"), (F.col("n") - F.col("bad") + k * (1 - F.col("m"))).alias("b"))
    judged = with_tail(posterior, odds / (1 + odds))
    return judged.select("site", "n", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), "tail", (F.col("tail") > confidence).alias("blocked"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules=RULES, lift: float = 2.0, confidence: float = 0.95) -> DataFrame:
    """page_id, host, path, rule, verdict, and n, rate, tail of the host. `outcomes`: (page_id, bad) of labelled pages."""
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("site", reputation_site(F.col("host")))
    known = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    sites = host_reputation(parsed.join(known, "page_id", "left").select("site", "bad"), lift, confidence)
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(sites, "site", "left")
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n", "rate", "tail")

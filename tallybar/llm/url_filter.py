"""URL filtering by rules and, where no rule fits, by empirical-Bayes host reputation.

Labelled pages are outcomes (bad or not). Their counts are shrunk through beta-binomial priors from the
whole to the suffix, from the suffix to the registered domain, and from there to the host: a level's prior
mean is the posterior mean of the level above, and its weight is estimated from how far the rates of that
level's members differ from the rates above them (method of moments, kept within ``WEIGHTS``). A host is
blocked if the lower ``Z``-bound of its posterior rate reaches ``BLOCK_AT``. All of it is DataFrame
expressions; counts are combined before each shuffle.

Defined results: a null url, or one without ``://``, has the empty host and path and no rule; a page
without outcome only receives a verdict; a null outcome does not count; repeated pages and outcomes count
each. Other columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Verdict and (host, path) of the rules in force.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Suffixes of two labels; every other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
BLOCK_AT, Z, WEIGHTS = 0.5, 1.645, (2.0, 200.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def levels(host: Column, two_label=TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, user and port taken off."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    labels = F.split(bare, r"\.")
    last_two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    last_three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    two = last_two.isin(*two_label)
    suffix = F.when(two, last_two).otherwise(F.element_at(labels, -1))
    return F.when(two, last_three).otherwise(last_two), suffix


def _shrunk(table: DataFrame, k: Column, n: Column, above: Column, weight: Column) -> tuple[Column, Column]:
    a = k + weight * above
    b = n - k + weight * (1 - above)
    return a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def _weight(table: DataFrame, above: str) -> Column:
    """The prior weight of a level as an aggregate over its rows (k, n, mean above)."""
    rate = F.col("k") / F.col("n")
    seen = F.col("n") > 0
    spread = F.sum(F.when(seen, F.col("n") * (rate - F.col(above)) * (rate - F.col(above))))
    noise = F.sum(F.when(seen, F.col(above) * (1 - F.col(above))))
    size = F.sum(F.when(seen, F.col("n")))
    between = F.try_divide(spread - noise, size)
    typical = F.try_divide(noise, F.sum(F.when(seen, F.lit(1))))
    weight = F.when(between > 0, F.try_divide(typical, between) - 1).otherwise(WEIGHTS[1])
    return F.greatest(F.lit(WEIGHTS[0]), F.least(F.lit(WEIGHTS[1]), F.coalesce(weight, F.lit(WEIGHTS[1]))))


def host_reputation(pages: DataFrame, outcomes: DataFrame, ws: Workspace) -> DataFrame:
    """host, n, bad, posterior mean, lower bound and verdict for every host of ``pages``.

    pages: page_id, host. outcomes: page_id, bad (boolean).
    """
    counted = outcomes.where("bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("k"))
    seen = pages.join(counted, "page_id", "left")
    domain, suffix = levels(F.col("host"))
    hosts = seen.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    hosts = ws.save(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    domains = ws.save(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("above"))
    parts = ws.save(suffixes.join(F.broadcast(whole)), "suffixes")
    weight = parts.agg(_weight(parts, "above").alias("w"))
    mean, _ = _shrunk(parts, F.col("k"), F.col("n"), F.col("above"), F.col("w"))
    parts = parts.join(F.broadcast(weight)).select("suffix", mean.alias("above"))
    domains = ws.save(domains.join(parts, "suffix"), "domains-above")
    mean, _ = _shrunk(domains, F.col("k"), F.col("n"), F.col("above"), F.col("w"))
    domains = domains.join(F.broadcast(domains.agg(_weight(domains, "above").alias("w")))).select("domain", mean.alias("above"))
    hosts = ws.save(hosts.join(domains, "domain"), "hosts-above")
    mean, deviation = _shrunk(hosts, F.col("k"), F.col("n"), F.col("above"), F.col("w"))
    hosts = hosts.join(F.broadcast(hosts.agg(_weight(hosts, "above").alias("w")))).select("host", "n", F.col("k").alias("bad"), mean.alias("mean"), F.greatest(F.lit(0.0), mean - Z * deviation).alias("bound"))
    return ws.save(hosts.withColumn("verdict", F.when(F.col("bound") >= BLOCK_AT, "block").otherwise("allow")), "reputation")


def judge_urls(pages: DataFrame, outcomes: DataFrame, ws: Workspace, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rating = host_reputation(split, outcomes, ws).select("host", F.col("verdict").alias("rated"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = split.join(rating, "host", "left")
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.col("rated")).alias("verdict"))

"""URL filters: allow and block rules, and an empirical-Bayes reputation for what no rule fits.

Labelled pages (blocked or not) are counted by host, registered domain and suffix. From the root down, each
level's prior is a beta distribution: its mean is the parent's posterior mean, its strength is fitted to
how much the children's rates differ, by moments. A page without a rule is blocked if the
lower bound of its host's posterior reaches the threshold. Hosts without labelled pages have their domain's
posterior, domains without any their suffix's, and so on up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import cut, session

#: (host, path, verdict): a rule fits its host and all subdomains where the url's path starts with its path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Standard deviations between the posterior mean and its lower bound; the bound at which a host is blocked.
BOUND, THRESHOLD = 1.645, 0.5
#: Least and greatest strength of a prior, in pages.
WEAKEST, STRONGEST = 2.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first :// up to /, ?, # or the end, A-Z in lower case; path: what follows the host
    up to ?, # or the end. Null or without ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _rule(rules, want: int) -> Column:
    """Of the longest fitting rule its text (want 0) or verdict (want 1); null if none fits."""
    out = None
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = (F if out is None else out).when(fits, F.lit((host + path, verdict)[want]))
    return F.lit(None).cast("string") if out is None else out


def _posteriors(counts: DataFrame, key: str, parent: str, prior: DataFrame) -> DataFrame:
    """counts (key, parent, n, b), prior (parent, mean of the parent) -> (key, n, b, alpha, beta, mean)."""
    rows = counts.join(prior, parent)
    # Moments over the children: their rates vary by mean * (1 - mean) * (1 / (s + 1)) besides the chance of n draws.
    p, m = F.col("b") / F.col("n"), F.col("mean")
    moments = rows.agg(F.sum(F.col("n") * (p - m) * (p - m)).alias("spread"), F.sum(m * (1 - m)).alias("chance"), F.sum(F.col("n") * m * (1 - m)).alias("most"))
    share = (F.col("spread") - F.col("chance")) / F.greatest(F.col("most") - F.col("chance"), F.lit(1e-9))
    strength = F.coalesce(F.least(F.greatest(1 / F.greatest(share, F.lit(1e-9)) - 1, F.lit(WEAKEST)), F.lit(STRONGEST)), F.lit(WEAKEST))
    one = F.lit(1).alias("one")
    rows = rows.select("*", one).join(F.broadcast(moments.select(strength.alias("s"), one)), "one")  # one row of sums
    alpha, beta = m * F.col("s") + F.col("b"), (1 - m) * F.col("s") + F.col("n") - F.col("b")
    return rows.select(key, alpha.alias("alpha"), beta.alias("beta"), (alpha / (alpha + beta)).alias("mean"))


def reputations(hosts: DataFrame) -> DataFrame:
    """hosts (host, n labelled pages, b blocked ones; n may be 0) -> (host, mean, bound) of the posterior blocked rate."""
    parts = F.split("host", r"\.")
    hosts = hosts.select("host", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("domain"), F.element_at(parts, -1).alias("suffix"), "n", "b")
    seen = hosts.where("n > 0")
    domains = seen.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).withColumn("root", F.lit(0))
    root = suffixes.groupBy("root").agg(((F.sum("b") + 0.5) / (F.sum("n") + 1)).alias("mean"), (F.sum("b") + 0.5).alias("alpha"), (F.sum("n") - F.sum("b") + 0.5).alias("beta"))
    of_suffix = cut(_posteriors(suffixes, "suffix", "root", root.select("root", "mean")))
    of_domain = cut(_posteriors(domains, "domain", "suffix", of_suffix.select("suffix", "mean")))
    of_host = _posteriors(seen.select("host", "domain", "n", "b"), "host", "domain", of_domain.select("domain", "mean"))
    pair = lambda t, key, name: t.select(key, F.struct("alpha", "beta").alias(name))
    out = hosts.join(pair(of_host, "host", "h"), "host", "left").join(pair(of_domain, "domain", "d"), "domain", "left").join(pair(of_suffix, "suffix", "s"), "suffix", "left")
    out = out.withColumn("root", F.lit(0)).join(F.broadcast(pair(root, "root", "r")), "root", "left")
    q = F.coalesce("h", "d", "s", "r", F.struct(F.lit(0.5).alias("alpha"), F.lit(0.5).alias("beta")))
    a, b = q["alpha"], q["beta"]
    mean = a / (a + b)
    return out.select("host", mean.alias("mean"), (mean - BOUND * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bound"))


def url_filter(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict, reputation, bound: one row per row of pages.

    labels (page_id, blocked boolean) are the outcomes that reputations rest on; without them, the pages that a
    rule decides are. Null urls and those without :// have an empty host, a host like any other. Null ids
    have no label. Several labels of an id are counted by their mean. With no outcome at all, all hosts have a mean of
    one half and are allowed, as the bound is below. Repeated rows count each. An empty table gives no rows.
    """
    session(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": _rule(rules, 0), "by_rule": _rule(rules, 1)})
    if labels is None:
        outcome = rows.select("host", (F.col("by_rule") == "block").cast("double").alias("blocked"))
    else:
        mean = labels.where("page_id is not null").groupBy("page_id").agg(F.avg(F.col("blocked").cast("double")).alias("blocked"))
        outcome = rows.join(mean, "page_id", "left").select("host", "blocked")
    hosts = cut(outcome.groupBy("host").agg(F.count("blocked").cast("double").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("b")))
    out = rows.join(cut(reputations(hosts)), "host")  # a written table: Spark can split a large host's partition
    verdict = F.coalesce("by_rule", F.when(F.col("bound") >= THRESHOLD, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("mean").alias("reputation"), "bound")

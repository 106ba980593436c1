"""URL filter: rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes (good or bad) are counted per host, registered domain and
suffix. Every level has a beta-binomial prior: its mean is the posterior mean of the
level above, its strength is estimated from how much the groups of the level differ
(method of moments). A host with few outcomes is thus shrunk towards its domain, a
domain towards its suffix, a suffix towards the overall rate. A page is blocked if
the lower bound of the posterior bad rate of its host (mean - z standard deviations)
is above ``block_above``.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
lower case. Path: what follows, up to ``?``, ``#`` or the end. A null url or one
without ``://`` has an empty host and path, which is a host like any other. Rules
are (host, path, verdict); a rule fits its host and all subdomains when the path
starts with its own; the longest fitting rule wins (a tie: the first in text order).
For domain and suffix, user names and ports are left out; the suffix is the last label,
or the last two if listed in ``two_label_suffixes``; the domain has one label more.

Counts are summed map-side, so a host with a third of all pages is one row a task;
the join back to the pages meets a written table, which lets Spark split that host.
SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

Z, BLOCK_ABOVE = 1.645, 0.5
STRENGTH = (2.0, 1000.0)
# Common suffixes of two labels.
TWO_LABEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz",
             "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    """Host of a url; empty if null or without ``://``."""
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.translate(F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1),
                                  UPPER, LOWER), F.lit(""))


def path_of(url: str | Column) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(c, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]):
    """(rule text, its verdict) of the longest fitting rule, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def levels_of(host: Column, two_label: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    wide = F.substring_index(name, ".", -2).isin(*two_label) if two_label else F.lit(False)
    suffix = F.when(wide, F.substring_index(name, ".", -2)).otherwise(
        F.substring_index(name, ".", -1))
    domain = F.when(wide, F.substring_index(name, ".", -3)).otherwise(
        F.substring_index(name, ".", -2))
    return domain, suffix


def _strength(counts: DataFrame) -> DataFrame:
    """One row: prior strength of a level, from the spread of its groups' rates."""
    sums = counts.where("n > 0").agg(
        F.sum("bad").alias("y"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("t2"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("yy"))
    p = (F.col("y") / F.col("t")).alias("p")
    s = sums.where("t > 0").withColumn("p", p)
    noise = F.col("p") * (1 - F.col("p"))
    spread = F.col("yy") - F.col("t") * F.col("p") * F.col("p")
    room = noise * (F.col("t") - F.col("t2") / F.col("t") - (F.col("k") - 1))
    rho = (spread - noise * (F.col("k") - 1)) / F.when(room > 0, room)
    strength = F.when(rho > 0, (1 - rho) / rho).otherwise(STRENGTH[1])
    bounded = F.least(F.greatest(strength, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))
    return s.select(bounded.alias("strength"))


def _one(table: DataFrame, name: str, default: float) -> float:
    row = table.select(name).first()
    return default if row is None or row[0] is None else float(row[0])


def reputation(pages: DataFrame, outcomes: DataFrame, page_key: str = "page_id",
               url: str = "url", outcome_key: str = "doc_id", bad: str = "bad",
               two_label: Sequence[str] = TWO_LABEL, z: float = Z) -> DataFrame:
    """One row per host of the pages: host, n, bad, mean, lower, upper (of the bad rate)."""
    told = outcomes.select(F.col(outcome_key).alias("key"), F.col(bad).cast("long").alias("bad"))
    told = told.where("bad IS NOT NULL").groupBy("key").agg(
        F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    rows = pages.select(F.col(page_key).alias("key"), host_of(url).alias("host"))
    domain, suffix = levels_of(F.col("host"), two_label)
    hosts = rows.join(told, "key", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}), "url-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"),
                                                    F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("p"))
    base = _one(total, "p", 0.5)
    m_suffix, m_domain, m_host = (_one(_strength(t), "strength", STRENGTH[1])
                                  for t in (suffixes, domains, hosts))
    s = suffixes.select("suffix", ((F.col("bad") + m_suffix * base)
                                   / (F.col("n") + m_suffix)).alias("above"))
    d = domains.join(s, "suffix").select(
        "domain", "suffix", ((F.col("bad") + m_domain * F.col("above"))
                             / (F.col("n") + m_domain)).alias("above"))
    h = hosts.join(d, ["domain", "suffix"])
    a = F.col("bad") + m_host * F.col("above")
    size = F.col("n") + m_host
    mean = a / size
    sd = F.sqrt(mean * (1 - mean) / (size + 1))
    return h.select("host", "n", "bad", mean.alias("mean"),
                    F.greatest(mean - z * sd, F.lit(0.0)).alias("lower"),
                    F.least(mean + z * sd, F.lit(1.0)).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (),
          page_key: str = "page_id", url: str = "url", outcome_key: str = "doc_id",
          bad: str = "bad", block_above: float = BLOCK_ABOVE, **settings) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, bad_rate, bad_rate_lower."""
    known = materialize(reputation(pages, outcomes, page_key, url, outcome_key, bad, **settings),
                        "url-reputation")
    rows = pages.select(F.col(page_key).alias("key"), host_of(url).alias("host"),
                        path_of(url).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("lower") > block_above, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(known, "host", "left").select(
        "key", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"),
        F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_rate_lower"))

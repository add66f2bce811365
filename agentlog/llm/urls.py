"""URL filtering: explicit rules, else the reputation of the host.

Reputation is empirical Bayes: labelled page outcomes of a host are shrunk towards its
registered domain, the domain towards its suffix, the suffix towards all pages. The
strength of each prior is estimated from the spread between the groups of its level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Suffixes of two labels; every other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, CAPITALS, CAPITALS.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and one label; a host of one label is its own."""
    two = "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES)
    found = F.regexp_extract(host, rf"([^.]+\.(?:{two}|[^.]+))$", 1)
    return F.when(found == "", host).otherwise(found)


def suffix_of(domain: Column) -> Column:
    return F.regexp_replace(domain, r"^[^.]*\.", "")


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. Rules are a list
    in the program's configuration, not data."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(
            path, F.lit(r.path)
        )
        found = F.when(
            fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        ).otherwise(found)
    return found


def prior_strength(groups: DataFrame, parent_mean: Column) -> float:
    """Pseudo-observations of a beta prior: moments of beta-binomial groups (n, bad).

    One row of sums reaches the driver. Spread no larger than chance gives the strongest
    prior allowed, spread of single outcomes the weakest.
    """
    rate = F.col("bad") / F.col("n")
    row = groups.filter("n > 0").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n").cast("double")).alias("n2"),
        F.sum(F.col("n") * (rate - parent_mean) * (rate - parent_mean)).alias("spread"),
        F.sum(F.col("n") * parent_mean * (1 - parent_mean)).alias("noise"),
    ).head()
    if not row["n"] or not row["noise"]:
        return 1000.0
    variance = row["noise"] / row["n"]
    free = row["n"] - row["n2"] / row["n"] - (row["k"] - 1)
    if free <= 0:
        return 1000.0
    rho = (row["spread"] - variance * (row["k"] - 1)) / (variance * free)
    rho = min(max(rho, 1 / 1001), 1 / 2)
    return (1 - rho) / rho


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, bad, bad_mean, bad_low, bad_high from rows (host, bad: 0, 1 or null).

    Outcomes that are null only make the host known. Bounds are the posterior mean of the
    bad rate and `z` standard deviations of the posterior beta.
    """
    hosts = outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")
    ).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    all_of = suffixes.agg(*sums).head()
    mean = (all_of["bad"] or 0) / all_of["n"] if all_of["n"] else 0.0

    def shrunk(groups: DataFrame, name: str) -> tuple[DataFrame, float]:
        strength = prior_strength(groups, F.col("prior"))
        posterior = (F.col("bad") + F.col("prior") * strength) / (F.col("n") + strength)
        return groups.withColumn(name, posterior).drop("prior", "n", "bad"), strength

    suffixes, _ = shrunk(suffixes.withColumn("prior", F.lit(mean)), "suffix_mean")
    domains, _ = shrunk(
        domains.join(suffixes, "suffix").withColumnRenamed("suffix_mean", "prior"), "domain_mean"
    )
    hosts = hosts.join(domains.select("domain", F.col("domain_mean").alias("prior")), "domain")
    strength = prior_strength(hosts, F.col("prior"))
    a = F.col("bad") + F.col("prior") * strength
    total = F.col("n") + strength
    posterior = a / total
    deviation = F.sqrt(posterior * (1 - posterior) / (total + 1))
    return hosts.select(
        "host", "n", "bad", posterior.alias("bad_mean"),
        F.greatest(F.lit(0.0), posterior - z * deviation).alias("bad_low"),
        F.least(F.lit(1.0), posterior + z * deviation).alias("bad_high"),
    )


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], url_col: str = "url",
    limit: float = 0.3, z: float = 1.645,
) -> DataFrame:
    """All rows of `pages` with host, path, rule, verdict and the host's bounds.

    Without a rule a page is blocked when even the lower bound of its host's bad rate is
    above `limit`. `outcomes` has rows (host, bad). Hosts without an outcome get their
    domain's rate; a null url has an empty host like any url without `://`. Repeated rows
    get equal results; empty tables give an empty result; columns named like the new ones
    are replaced. A host of any size is reduced before the shuffle; page rows meet their
    host in a join that Spark broadcasts or splits by size.
    """
    names = ["host", "path", "rule", "verdict", "bad_mean", "bad_low", "bad_high"]
    split = pages.drop(*names).withColumn("host", host_of(F.col(url_col))).withColumn(
        "path", path_of(F.col(url_col))
    )
    known = outcomes.select("host", "bad").unionByName(
        split.select("host", F.lit(None).cast("int").alias("bad"))
    )
    hosts = host_reputation(known, z).select("host", "bad_mean", "bad_low", "bad_high")
    found = F.col("__found")
    by_host = F.when(F.col("bad_low") > limit, "block").otherwise("allow")
    return (
        split.withColumn("__found", matching_rule(F.col("host"), F.col("path"), rules))
        .join(hosts, "host", "left")
        .withColumn("rule", found["rule"])
        .withColumn("verdict", F.coalesce(found["verdict"], by_host))
        .drop("__found")
    )


def labelled_outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, bad) of pages whose path ends in the number of a labelled document: bad when
    the document is of low quality or toxic."""
    number = F.regexp_extract(path_of(F.col(url_col)), r"/([0-9]{1,18})/?$", 1)
    numbered = (
        pages.select(host_of(F.col(url_col)).alias("host"), number.alias("__n"))
        .filter("__n != ''").select("host", F.col("__n").cast("long").alias("doc_id"))
    )
    bad = F.greatest(1 - F.col("quality"), F.col("toxic")).cast("int")
    judged = labels.select("doc_id", bad.alias("bad")).filter("bad IS NOT NULL")
    return numbered.join(judged, "doc_id").select("host", "bad")

"""URL filter by Empirical-Bayes host reputation, with path rules before it.

Labelled page outcomes (bad: 0 or 1) are counted per host. Bad shares are shrunk level by level through
beta-binomial priors: all pages to suffix, suffix to registered domain, domain to host. A level's prior
has the posterior mean of the level above as its mean, and a strength (pseudo-pages) fitted to how much
the level's groups differ beyond binomial noise (method of moments on counts; the weakest strength where
they do not). The strength is lowered by the variance of the posterior above, so that a level knows no more
than what it comes from. A host is blocked if the lower bound of its posterior bad share exceeds the share
of all pages times a factor; hosts without outcomes get their domain's posterior, unknown domains their
suffix's, and unknown suffixes the prior of all pages.

Only counts leave the pages: outcomes are aggregated before every shuffle, the counts of hosts are
written once, and the three levels meet in joins whose right side has one row per key.

Defined results: a null url, or one without "://", has an empty host and path; it is judged as the host
"". Repeated pages are judged one by one; a page counts as often as it has outcomes, null outcomes not at
all. Ids may be null. Without any outcome every share is `base_share`. Extra columns are ignored. An empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written

#: (verdict, host, start of the path). A rule fits its host and all hosts below it.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of two labels under which names are registered; all others have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in")
#: Rules are part of the plan, so their number is bounded.
MAX_RULES = 1000


@dataclass(frozen=True)
class ReputationLimits:
    """Parameters of the priors and of the verdict."""

    #: Block when the lower bound of the bad share exceeds this times the share of all pages.
    max_ratio: float = 1.0
    #: Normal quantile of the bound (0.8416: 80 %, one-sided).
    z: float = 0.8416
    #: Bounds of the fitted strength of a prior, in pages.
    min_strength: float = 2.0
    max_strength: float = 1000.0
    #: Share and strength of the prior of all pages.
    base_share: float = 0.1
    base_strength: float = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first "://" and path after it; both empty without one."""
    found = F.instr(url, "://") > 0
    rest = F.expr("substr(_url, instr(_url, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(found, host).otherwise(""), F.when(found, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, null where none fits (ties: the longer host)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def levels_of(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain of a host; an address in numbers and a bare suffix stand for themselves."""
    plain = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.when(F.substring_index(plain, ".", -2).isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)
    address = plain.rlike(r"^[0-9.]+$|^\[")
    last = F.when(labels == 2, F.substring_index(plain, ".", -2)).otherwise(F.substring_index(plain, ".", -1))
    domain = F.when(labels == 2, F.substring_index(plain, ".", -3)).otherwise(F.substring_index(plain, ".", -2))
    return F.when(address, plain).otherwise(last), F.when(address, plain).otherwise(domain)


def _strength(groups: DataFrame, limits: ReputationLimits) -> DataFrame:
    """One row: the prior strength that explains how far the groups' shares lie from their prior means.

    With n pages, share p and prior mean m: the sum of n (p - m)^2 / (m (1 - m)) is the number of
    groups if nothing but chance is at work, and grows with n / (strength + 1) beyond that. Terms are
    rounded to decimals, so the sum does not depend on the order of rows.
    """
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2) / (F.col("mean") * (1 - F.col("mean")))
    total = groups.where("n > 0").agg(
        F.sum(spread.cast("decimal(28,9)")).cast("double").alias("q"), F.count("*").cast("double").alias("k"), F.sum("n").cast("double").alias("pages")
    )
    fitted = (F.col("pages") - F.col("k")) / (F.col("q") - F.col("k")) - 1
    strength = F.when(F.coalesce(F.col("q") > F.col("k"), F.lit(False)), F.greatest(F.lit(limits.min_strength), F.least(F.lit(limits.max_strength), fitted)))
    return total.select(F.coalesce(strength, F.lit(limits.min_strength)).alias("fitted"))


def _shrunk(groups: DataFrame, limits: ReputationLimits) -> DataFrame:
    """Posterior of each group (with mean and var of the level above): its pseudo-counts a (bad) and b (good)."""
    prior = groups.crossJoin(F.broadcast(_strength(groups, limits)))  # one row
    spread = 1 / (F.col("fitted") + 1) + F.col("var") / (F.col("mean") * (1 - F.col("mean")))
    prior = prior.withColumn("strength", F.greatest(F.lit(limits.min_strength), 1 / spread - 1))
    return prior.withColumn("a", F.col("strength") * F.col("mean") + F.col("bad")).withColumn(
        "b", F.col("strength") * (1 - F.col("mean")) + F.col("n") - F.col("bad")
    )


def _moments() -> tuple[Column, Column]:
    """Mean and variance of the posterior of columns a and b."""
    a, b = F.col("a"), F.col("b")
    return (a / (a + b)).alias("mean"), (a * b / ((a + b) * (a + b) * (a + b + 1))).alias("var")


def posterior(hosts: DataFrame, limits: ReputationLimits = ReputationLimits()) -> DataFrame:
    """hosts (host, suffix, domain, n, bad; one row per host) with pseudo-counts a and b, and share_of_all, of every host."""
    top = hosts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    bad, good = limits.base_share * limits.base_strength, (1 - limits.base_share) * limits.base_strength
    every = top.select((bad + F.col("bad")).alias("a"), (good + F.col("n") - F.col("bad")).alias("b")).select(*_moments())
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(every))
    suffixes = written(_shrunk(suffixes, limits).select("suffix", *_moments()), "suffixes")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    domains = written(_shrunk(domains, limits).select("domain", *_moments()), "domains")
    found = _shrunk(hosts.join(domains, "domain"), limits).select("host", "n", "bad", "a", "b")
    return found.crossJoin(F.broadcast(every.select(F.col("mean").alias("share_of_all"))))  # one row


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """Lower bound of a beta distribution: mean less z standard deviations, 0 at least."""
    mean = a / (a + b)
    return F.greatest(F.lit(0.0), mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, limits: ReputationLimits = ReputationLimits()) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, host_bad_share and bound.

    outcomes: (the id column, bad) with bad 0, 1 or null; ids that are not in pages do not count.
    """
    split = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    split = split.select("_id", host.alias("host"), path.alias("path"))
    labels = outcomes.select(F.col(id_col).alias("_id"), F.col("bad").cast("long").alias("_bad")).where("_bad is not null and _id is not null")
    labels = labels.groupBy("_id").agg(F.count("*").alias("_n"), F.sum("_bad").alias("_bad"))
    counted = split.join(labels, "_id", "left").groupBy("host").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    suffix, domain = levels_of(F.col("host"))
    # One row per host, read by every level.
    counted = written(counted.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "bad"), "hosts")
    judged = posterior(counted, limits)
    bound = lower_bound(F.col("a"), F.col("b"), limits.z)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > limits.max_ratio * F.col("share_of_all"), "block").otherwise("allow")
    hosts = judged.select("host", "share_of_all", (F.col("a") / (F.col("a") + F.col("b"))).alias("share"), bound.alias("bound"))
    return split.join(hosts, "host", "left").select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, own).alias("verdict"),
        F.round("share", 6).alias("host_bad_share"),
        F.round("bound", 6).alias("bound"),
    )

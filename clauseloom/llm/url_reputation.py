"""URL filters: fixed rules first, then empirical-Bayes host reputation.  DataFrame functions only.

Labelled page outcomes are counted per host, registered domain and suffix.  Each level
is shrunk to the one above by a beta-binomial prior: its mean is the level above, its
strength is fitted to the spread of the rates at that level by the method of moments.
A page whose host is worse than most beyond doubt - the lower bound of its posterior bad
rate lies above a multiple of the rate of all pages - is blocked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Reputation:
    """``lift``: how many times the bad rate of all pages a host's bound may be to be let through, and
    ``limit``: the highest bound let through whatever that rate; ``z``: posterior standard deviations of
    the bound; strengths of fitted priors lie between ``weakest`` and ``strongest`` outcomes."""

    lift: float = 1.25
    limit: float = 0.5
    z: float = 1.645
    weakest: float = 2.0
    strongest: float = 1000.0


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """Last two labels; the whole host where it has fewer."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column, value: str) -> Column:
    """``value`` (text or verdict) of the longest rule that fits; ties go to the earlier rule."""
    options = [
        F.when(rule_fits(rule, host, path), F.lit(getattr(rule, value)))
        for rule in sorted(rules, key=lambda r: -len(r.text))
    ]
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def _strength(level: DataFrame, options: Reputation) -> float:
    """Strength of the beta prior that explains the spread of the rates around their means."""
    n, mean = F.col("n"), F.col("mean")
    noise = mean * (1 - mean)
    # E[n (rate - mean)^2] = noise * (1 + (n - 1) * rho) for a spread of rho.
    spread = F.sum(n * F.pow(F.col("bad") / n - mean, 2)) - F.sum(noise)
    excess, weight = level.agg(spread, F.sum(noise * (n - 1))).first()
    rho = excess / weight if weight else 0.0
    return max(options.weakest, min(options.strongest, 1 / rho - 1 if rho > 0 else options.strongest))


def _shrunk(level: DataFrame, options: Reputation) -> DataFrame:
    """``level`` (n, bad, mean of the level above) with its posterior rate and its lower bound."""
    strength = F.lit(_strength(level, options))
    alpha = strength * F.col("mean") + F.col("bad")
    beta = strength - strength * F.col("mean") + F.col("n") - F.col("bad")
    return _bounded(level.withColumn("alpha", alpha).withColumn("beta", beta), options).drop("mean")


def _bounded(level: DataFrame, options: Reputation) -> DataFrame:
    size = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (size * size * (size + 1)))
    rate = F.col("alpha") / size
    return level.withColumn("rate", rate).withColumn("lower", rate - options.z * deviation).drop("alpha", "beta")


@dataclass(frozen=True)
class Levels:
    """Rows name, n, bad, rate, lower of each level; rate and lower of all pages."""

    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    rate: float
    lower: float


def host_reputation(outcomes: DataFrame, options: Reputation = Reputation()) -> Levels:
    """Posterior of each labelled host, domain and suffix from ``outcomes`` (host, bad boolean).

    Null outcomes are left out.  Counts are combined before the shuffle, so a host with
    most of the pages is no hot group, and are stored: the levels read them, not the pages.
    """
    labelled = outcomes.where("bad is not null").select("host", F.col("bad").cast("long").alias("bad"))
    hosts = stored(
        labelled.groupBy("host")
        .agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
        .select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    )
    counts = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(*(F.coalesce(c, F.lit(0)) for c in counts)).first()
    alpha, beta = total[1] + 1.0, total[0] - total[1] + 1.0
    size = alpha + beta
    lower = alpha / size - options.z * math.sqrt(alpha * beta / (size * size * (size + 1)))
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*counts).withColumn("mean", F.lit(alpha / size)), options)
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    domains = _shrunk(domains.join(suffixes.select("suffix", F.col("rate").alias("mean")), "suffix"), options)
    named = hosts.join(domains.select("domain", F.col("rate").alias("mean")), "domain")
    return Levels(_shrunk(named, options), domains, suffixes, alpha / size, lower)


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, options: Reputation = Reputation()
) -> DataFrame:
    """Verdict for every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, reputation.

    ``outcomes`` holds (page_id, bad boolean): pages labelled good or bad.  The longest
    rule that fits decides; without one, a page is blocked if the lower posterior bound of
    its host lies above ``lift`` times the rate of all pages or above ``limit``, and allowed
    otherwise.  A host without labelled pages
    takes the bound of its domain, then its suffix, then of all pages.  ``reputation`` is
    the bound.  Null urls and urls without ``://`` have an empty host and path, and
    empty hosts share a reputation.  Repeated rows are judged one by one; null page ids
    and null outcomes carry no label; of several outcomes of a page each counts, for each
    row of the page; other columns are ignored; an empty table gives no rows.
    """
    url = F.col("url")
    read = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    labels = outcomes.where("page_id is not null and bad is not null").select("page_id", F.col("bad").cast("boolean"))
    levels = host_reputation(read.select("page_id", "host").join(labels, "page_id"), options)
    # Bounds are joined to the distinct hosts, then once to the pages.
    known = (
        read.groupBy("host")
        .agg(F.count("*").alias("_pages"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host")))
        .join(levels.hosts.select("host", F.col("lower").alias("_host")), "host", "left")
        .join(levels.domains.select("domain", F.col("lower").alias("_domain")), "domain", "left")
        .join(levels.suffixes.select("suffix", F.col("lower").alias("_suffix")), "suffix", "left")
        .select("host", F.coalesce("_host", "_domain", "_suffix", F.lit(levels.lower)).alias("reputation"))
    )
    host, path = F.col("host"), F.col("path")
    limit = min(options.limit, options.lift * levels.rate)
    by_reputation = F.when(F.col("reputation") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return read.join(known, "host").select(
        "page_id",
        "host",
        "path",
        longest_rule(rules, host, path, "text").alias("rule"),
        F.coalesce(longest_rule(rules, host, path, "verdict"), by_reputation).alias("verdict"),
        "reputation",
    )


def oracle_sql() -> str:
    """DuckDB twin of ``judge`` on pages and labels with the default options, ``reputation`` to six digits."""
    o = Reputation()
    ordered = sorted(RULES, key=lambda r: -len(r.text))

    def cases(value: str) -> str:
        whens = " ".join(
            f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') "
            f"then '{getattr(r, value)}'"
            for r in ordered
        )
        return f"case {whens} end"

    def shrunk(level: str, source: str) -> str:
        return f"""{level}_s as (select greatest({o.weakest}, least({o.strongest}, coalesce(
            case when rho > 0 then 1 / rho - 1 end, {o.strongest}))) as strength from (
            select (sum(n * pow(bad / n::double - mean, 2)) - sum(mean * (1 - mean)))
              / nullif(sum(mean * (1 - mean) * (n - 1)), 0) as rho from {source})),
        {level}_p as (select *, strength * mean + bad as a, strength - strength * mean + n - bad as b,
            a / (a + b) as rate, a / (a + b) - {o.z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as lower
            from {source}, {level}_s)"""

    return f"""
    with raw as (select page_id, url, position('://' in url) as cut from pages),
    split as (select page_id, case when cut > 0 then substr(url, cut + 3) else '' end as rest from raw),
    r as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from split),
    h0 as (select host, count(*) as n, sum((quality = 0 or toxic = 1)::int)::double as bad
        from r join labels on page_id = doc_id where quality is not null and toxic is not null group by host),
    h1 as (select *, regexp_extract(host, '([^.]*[.])?[^.]*$') as domain, regexp_extract(host, '[^.]*$') as suffix from h0),
    t as (select (coalesce(sum(bad), 0) + 1) as a, (coalesce(sum(n), 0) - coalesce(sum(bad), 0) + 1) as b, a / (a + b) as rate,
        a / (a + b) - {o.z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as lower from h1),
    s0 as (select suffix, sum(n) as n, sum(bad) as bad, any_value(t.rate) as mean from h1, t group by suffix),
    {shrunk("s", "s0")},
    d0 as (select domain, any_value(h1.suffix) as suffix, sum(h1.n) as n, sum(h1.bad) as bad, any_value(s_p.rate) as mean
        from h1 join s_p on h1.suffix = s_p.suffix group by domain),
    {shrunk("d", "d0")},
    g0 as (select h1.host, h1.n, h1.bad, d_p.rate as mean from h1 join d_p on h1.domain = d_p.domain),
    {shrunk("g", "g0")}
    select page_id, r.host, path, {cases("text")} as rule,
        coalesce({cases("verdict")}, case when coalesce(g_p.lower, d_p.lower, s_p.lower, t.lower)
            > least({o.limit}, {o.lift} * t.rate) then 'block' else 'allow' end) as verdict,
        round(coalesce(g_p.lower, d_p.lower, s_p.lower, t.lower), 6) as reputation
    from r cross join t left join g_p on r.host = g_p.host
        left join d_p on regexp_extract(r.host, '([^.]*[.])?[^.]*$') = d_p.domain
        left join s_p on regexp_extract(r.host, '[^.]*$') = s_p.suffix
    """.replace("r.host, path, case", "r.host as host, path, case").replace("(host = '", "(r.host = '").replace(
        "ends_with(host,", "ends_with(r.host,"
    )

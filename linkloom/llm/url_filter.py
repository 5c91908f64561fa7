"""URL rules, and empirical-Bayes reputation for the hosts that no rule names.

Rules judge the pages they fit. Those judged pages are the labelled outcomes
from which hosts are rated: outcomes are counted per host, and the share of
allowed pages is shrunk through beta-binomial priors, suffix towards all hosts,
registered domain towards its suffix, host towards its domain. How strongly is
estimated from the counts at each level. A host is blocked when the upper bound
of its posterior share lies below a threshold, so hosts that little is known
about pass with their relatives.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import LOWER, UPPER
from linkloom.operators.storage import RunFolder


@dataclass(frozen=True)
class Rule:
    """``place`` is a host followed by a path prefix, such as ``example.org/es/``."""

    verdict: str
    place: str

    @property
    def host(self) -> str:
        return self.place.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.place[len(self.host) :]


RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)
THRESHOLD, Z = 0.5, 1.645
#: Overdispersion where the counts say nothing, and the range it is kept in.
RHO, RHO_LEAST, RHO_MOST = 0.5, 0.001, 0.99
#: Public suffixes of more than one label; others are a host's last label.
SUFFIXES: tuple[str, ...] = ()


def url_host(url: Column) -> Column:
    return F.translate(_part(url, r"\A([^/?#]*+)"), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return _part(url, r"\A[^/?#]*+([^?#]*+)")


def _part(url: Column, pattern: str) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.regexp_extract(rest, pattern, 1)).otherwise("")


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.place), r.place)):
        on_host = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        found = F.when(on_host & F.startswith(path, F.lit(rule.path)), rule.place).otherwise(found)
    return found


def host_suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    found = F.substring_index(host, ".", -1)
    for suffix in sorted(suffixes, key=len):
        fits = (host == suffix) | F.endswith(host, F.lit("." + suffix))
        found = F.when(fits, suffix).otherwise(found)
    return found


def registered_domain(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; an address of numbers is its own domain."""
    before = F.substr(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    domain = F.concat_ws(".", F.substring_index(before, ".", -1), suffix)
    return F.when((host == suffix) | host.rlike(r"\A[0-9.:]+\z"), host).otherwise(domain)


def _rho(children: DataFrame, mean: str) -> float:
    """Overdispersion of child counts ``(good, n)`` around their parents' ``mean``.

    A child's ``n (share - mean)^2`` is ``v (1 + (n - 1) rho)`` on average, where
    ``v = mean (1 - mean)``; summed over children this gives ``rho``.
    """
    v = F.col(mean) * (1 - F.col(mean))
    seen = children.filter("n > 0").select(
        (F.pow(F.col("good") - F.col("n") * F.col(mean), F.lit(2.0)) / F.col("n") - v).alias("over"),
        (v * (F.col("n") - 1)).alias("room"),
    )
    over, room = seen.agg(F.sum("over"), F.sum("room")).first()
    rho = RHO if not room else over / room
    return min(max(rho, RHO_LEAST), RHO_MOST)


def _posterior(mean: Column, rho: float) -> tuple[Column, Column]:
    strength = (1 - rho) / rho
    a = mean * strength + F.col("good")
    b = (1 - mean) * strength + (F.col("n") - F.col("good"))
    return a, b


def rate_hosts(outcomes: DataFrame, run: RunFolder, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``(host, share, bound)`` for every host of ``outcomes(host, good)``.

    ``good`` is 1, 0 or null for a page without an outcome. Counting combines
    before its shuffle, so a host with a third of all pages costs no more than
    any other; from there on there is one row per host.
    """
    suffix = host_suffix(F.col("host"), suffixes)
    hosts = run.keep(
        outcomes.groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
        .withColumn("suffix", suffix)
        .withColumn("domain", registered_domain(F.col("host"), F.col("suffix"))),
        "hosts",
    )
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    prior = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)

    def counts(key: str, *more: str) -> DataFrame:
        return hosts.groupBy(key, *more).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    def shrunk(children: DataFrame, key: str, out: str) -> DataFrame:
        a, b = _posterior(F.col("mean"), _rho(children, "mean"))
        return children.select(key, (a / (a + b)).alias(out))

    by_suffix = counts("suffix").withColumn("mean", F.lit(prior))
    suffixes_rated = run.keep(shrunk(by_suffix, "suffix", "mean"), "suffixes")
    by_domain = counts("domain", "suffix").join(suffixes_rated, "suffix")
    domains_rated = run.keep(shrunk(by_domain, "domain", "mean"), "domains")
    by_host = hosts.join(domains_rated, "domain")
    a, b = _posterior(F.col("mean"), _rho(by_host, "mean"))
    rated = by_host.select("host", a.alias("a"), b.alias("b"))
    share = F.col("a") / (F.col("a") + F.col("b"))
    deviation = F.sqrt(share * (1 - share) / (F.col("a") + F.col("b") + 1))
    return run.keep(rated.select("host", share.alias("share"), (share + Z * deviation).alias("bound")), "rated")


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: tuple[Rule, ...] = RULES,
    threshold: float = THRESHOLD,
    suffixes: tuple[str, ...] = SUFFIXES,
) -> DataFrame:
    """The rows of ``pages`` with ``host, path, rule, verdict, share`` in ``judged``.

    A null URL, or one without ``://``, has an empty host and path; as a host of
    no outcomes it is judged by the prior. Repeated rows are all judged, an empty
    table gives an empty result, and input columns keep their names in ``row``.
    ``rules`` is a parameter of a moderate number of literals.
    """
    run = RunFolder(pages.sparkSession, "url_filter")
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row")
    placed = pages.select(
        row, url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path")
    ).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule in rules:
        by_rule = F.when(F.col("rule") == rule.place, rule.verdict).otherwise(by_rule)
    placed = placed.withColumn("by_rule", by_rule)
    outcomes = placed.select("host", F.when(F.col("by_rule") == "allow", 1).when(F.col("by_rule") == "block", 0).alias("good"))
    rated = rate_hosts(outcomes, run, suffixes)
    by_method = F.when(F.col("bound") < threshold, "block").otherwise("allow")
    verdict = F.coalesce("by_rule", by_method)
    # Small rows, and a plain join of two shuffled sides: a hot host is split by
    # adaptive execution.
    return placed.join(rated, "host", "left").select(
        "row", F.struct("host", "path", "rule", verdict.alias("verdict"), "share").alias("judged")
    )


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge_urls(pages)
    return judged.select(
        "row.page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict",
        F.round("judged.share", 6).alias("share"),
    )


def _sql() -> str:
    fits, verdicts = "NULL", "NULL"
    for r in sorted(RULES, key=lambda r: (len(r.place), r.place)):
        host = f"(host = '{r.host}' OR ends_with(host, '.{r.host}'))"
        fits = f"CASE WHEN {host} AND starts_with(path, '{r.path}') THEN '{r.place}' ELSE {fits} END"
        verdicts = f"CASE WHEN rule = '{r.place}' THEN '{r.verdict}' ELSE {verdicts} END"

    def rho(children: str) -> str:
        return f"""(SELECT least(greatest(coalesce(
          sum(power(good - n * mean, 2) / n - mean * (1 - mean)) / nullif(sum(mean * (1 - mean) * (n - 1)), 0),
          {RHO}), {RHO_LEAST}), {RHO_MOST}) FROM {children} WHERE n > 0)"""

    def share(rho: str) -> str:
        s = f"((1 - {rho}) / {rho})"
        return f"(mean * {s} + good) / (mean * {s} + good + (1 - mean) * {s} + n - good)"

    s = "((1 - rho) / rho)"
    return f"""
WITH parts AS (SELECT page_id,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
placed AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
ruled AS (SELECT *, {fits} AS rule FROM placed),
judged AS (SELECT *, {verdicts} AS by_rule FROM ruled),
hosts AS (SELECT host, count(by_rule) AS n, count(*) FILTER (by_rule = 'allow') AS good,
  regexp_extract(host, '([^.]*)$', 1) AS suffix,
  CASE WHEN strpos(host, '.') = 0 OR regexp_matches(host, '^[0-9.:]+$') THEN host
   ELSE regexp_extract(host, '([^.]*[.][^.]*)$', 1) END AS domain FROM judged GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good,
  (SELECT (sum(good) + 1) / (sum(n) + 2) FROM hosts) AS mean FROM hosts GROUP BY suffix),
s1 AS (SELECT *, {rho('s0')} AS rho FROM s0),
s2 AS (SELECT suffix, {share('rho')} AS mean FROM s1),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain, suffix),
d1 AS (SELECT d0.*, mean FROM d0 JOIN s2 USING (suffix)),
d2 AS (SELECT *, {rho('d1')} AS rho FROM d1),
d3 AS (SELECT domain, {share('rho')} AS mean FROM d2),
h1 AS (SELECT hosts.*, mean FROM hosts JOIN d3 USING (domain)),
h2 AS (SELECT *, {rho('h1')} AS rho FROM h1),
h3 AS (SELECT host, mean * {s} + good AS a, (1 - mean) * {s} + n - good AS b FROM h2),
rated AS (SELECT host, a / (a + b) AS share,
  a / (a + b) + {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM h3)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN bound < {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
 round(share, 6) AS share
FROM judged LEFT JOIN rated USING (host)
"""


URL_FILTER_SQL = _sql()

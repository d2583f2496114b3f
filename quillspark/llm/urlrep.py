"""Host reputation by empirical Bayes: beta-binomial shrinkage from host to registered domain to suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

#: (action, host, path); the host and its subdomains fit when the url's path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Blocked where the lower bound of the posterior share of bad pages lies above this.
BLOCK_ABOVE = 0.5
#: Standard normal quantile of the posterior bound (one-sided 95 %).
Z = 1.645
#: Weight of the level above, in pseudo-pages, where its members are too few to estimate a spread.
DEFAULT_STRENGTH = 4.0
#: Estimated prior strengths stay within these.
STRENGTHS = (1.0, 200.0)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    host = F.coalesce(_ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))
    return host, path


#: A name without its port: an IPv4 address is whole; else the suffix is the last label, or the last two where a country's
#: two letters follow a label that such suffixes begin with, and the domain has one label more.
_PORT = r":[0-9]*$"
_ADDRESS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
_SUFFIX = r"((^|\.)(ac|co|com|edu|gov|net|org|or|ne|go)\.[a-z]{2}|[^.]*)$"
_DOMAIN = r"([^.]+\.(ac|co|com|edu|gov|net|org|or|ne|go)\.[a-z]{2}|([^.]*\.)?[^.]*)$"


def _with_levels(df: DataFrame) -> DataFrame:
    """Registered domain and suffix of ``host``; both are the address itself where it is one."""
    name = F.regexp_replace("host", _PORT, "")
    level = lambda p: F.when(name.rlike(_ADDRESS), name).otherwise(F.regexp_replace(F.regexp_extract(name, p, 0), r"^\.", ""))
    return df.withColumns({"domain": level(_DOMAIN), "suffix": level(_SUFFIX)})


def _strength(n: Column, bad: Column, mean: Column) -> Column:
    """Prior strength by the method of moments over a level's members, as an aggregate.

    The members' shares spread by mean (1 - mean) (1 + (n - 1) rho) / n each; the weighted spread gives rho,
    and the strength of the beta prior is 1 / rho - 1.
    """
    k, total = F.count(n), F.sum(n)
    spread = F.sum(n * (bad / n - mean) * (bad / n - mean))
    base = F.max(mean) * (1 - F.max(mean))
    gap = total - F.sum(n * n) / total - (k - 1)
    rho = (spread - base * (k - 1)) / (base * gap)
    held = F.least(F.greatest(1 / rho - 1, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1]))
    return (
        F.when((k < 2) | (base <= 0) | (gap <= 0), F.lit(DEFAULT_STRENGTH))
        .when(rho <= 0, F.lit(STRENGTHS[1]))
        .otherwise(held)
    )


def host_reputation(outcomes: DataFrame, hosts: DataFrame | None = None, z: float = Z) -> DataFrame:
    """Posterior of each host's share of bad pages.

    ``outcomes``: (host string, bad int 0/1), one row per labelled page. ``hosts`` (host) may name more hosts: one
    without labelled pages has the prior of the nearest level above that has some. Returns a row per host: host, n, bad,
    prior_a, prior_b, p_mean, p_low, p_high. Pages are summed per host before anything else, so a hot host is
    one row; domains and suffixes sum those rows. At each level the rate of the level above is the prior mean
    and the spread among the siblings gives the prior's strength; the root's prior is Beta(1, 1).
    The bounds are the normal approximation mean -/+ z sd of the beta posterior, cut to [0, 1].
    Null hosts or outcomes take no part; no hosts give no rows.
    """
    pages = outcomes.where("host is not null and bad is not null")
    if hosts is not None:  # a row without an outcome for each host, so that one aggregate gives them all
        pages = pages.select("host", "bad").unionByName(hosts.where("host is not null").select("host", F.lit(None).cast("int").alias("bad")))
    sums = pages.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    # the levels are read several times each; a row per host, domain and suffix is all they hold
    every = materialize(_with_levels(sums), "hosts")
    seen = every.where("n > 0")
    domains = materialize(seen.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad")), "suffixes")
    root = suffixes.agg(((F.sum("sbad") + 1) / (F.sum("sn") + 2)).alias("p0"))
    # one row: the root's rate and the strength of the suffixes' prior
    top = suffixes.crossJoin(F.broadcast(root)).agg(F.coalesce(F.max("p0"), F.lit(0.5)).alias("p0"), _strength(F.col("sn"), F.col("sbad"), F.col("p0")).alias("s0"))
    top = materialize(top, "root")
    suffix_rate = suffixes.crossJoin(F.broadcast(top)).select(
        "suffix", ((F.col("sbad") + F.col("s0") * F.col("p0")) / (F.col("sn") + F.col("s0"))).alias("p1")
    )
    domain_in = domains.join(suffix_rate, "suffix")
    s1 = domain_in.groupBy("suffix").agg(_strength(F.col("dn"), F.col("dbad"), F.col("p1")).alias("s1"))
    domain_rate = domain_in.join(s1, "suffix").select(
        "domain", ((F.col("dbad") + F.col("s1") * F.col("p1")) / (F.col("dn") + F.col("s1"))).alias("p2")
    )
    host_in = seen.join(domain_rate, "domain")
    s2 = host_in.groupBy("domain").agg(_strength(F.col("n"), F.col("bad"), F.col("p2")).alias("s2"))
    of_domain = domain_rate.join(s2, "domain")
    of_suffix = suffix_rate.join(s1, "suffix")
    # what stands above a host: its domain, else its suffix, else the root
    above = every.join(of_domain, "domain", "left").join(of_suffix, "suffix", "left").crossJoin(F.broadcast(top))
    above = above.withColumns({"p2": F.coalesce("p2", "p1", "p0"), "s2": F.coalesce("s2", "s1", "s0")})
    a, b = F.col("prior_a") + F.col("bad"), F.col("prior_b") + F.col("n") - F.col("bad")
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return (
        above
        .withColumns({"prior_a": F.col("s2") * F.col("p2"), "prior_b": F.col("s2") * (1 - F.col("p2"))})
        .select(
            "host",
            F.col("n").cast("long").alias("n"),
            F.col("bad").cast("long").alias("bad"),
            "prior_a",
            "prior_b",
            mean.alias("p_mean"),
            F.greatest(mean - z * sd, F.lit(0.0)).alias("p_low"),
            F.least(mean + z * sd, F.lit(1.0)).alias("p_high"),
        )
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its action; nulls where none fits."""
    name = action = None
    for verdict, at, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name = F.when(fits, F.lit(at + start)) if name is None else name.when(fits, F.lit(at + start))
        action = F.when(fits, F.lit(verdict)) if action is None else action.when(fits, F.lit(verdict))
    return name, action


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, block_above: float = BLOCK_ABOVE, z: float = Z) -> DataFrame:
    """Judge every url of ``pages`` (page_id, url) by rules, then by its host's reputation.

    ``outcomes``: (page_id, bad 0/1 or null), joined to the pages for the labelled outcomes; a page with
    several outcomes counts each. Returns page_id, host, path, rule, verdict and the posterior (p_mean, p_low).
    A host without labelled pages has the prior of its domain, suffix or the root (n_labelled 0). The empty host of a
    null or malformed url has no posterior and is allowed. Repeated rows stay repeated; an empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    host, path = split_url(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = seen.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id").where("host <> ''")
    reputation = host_reputation(labelled, seen.where("host <> ''").select("host"), z).select("host", "p_mean", "p_low", F.col("n").alias("n_labelled"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    judged = seen.join(reputation, "host", "left")
    own = F.when(F.col("p_low") > block_above, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"),
        F.round("p_mean", 9).alias("p_mean"), F.round("p_low", 9).alias("p_low"), "n_labelled",
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcome of a labelled page: bad where its quality is 0 or it is toxic; unknown where both are null."""
    bad = ((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int")
    return labels.select(
        F.col("doc_id").alias("page_id"), F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), bad).alias("bad")
    )


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of ``pages`` from the outcomes in ``labels``. Cases as in ``url_filter``."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return url_filter(pages, page_outcomes(labels))


def _sql_strength(n: str, bad: str, mean: str) -> str:
    k, total, base = f"count({n})", f"sum({n})", f"(max({mean}) * (1 - max({mean})))"
    gap = f"({total} - sum({n} * {n}) / {total} - ({k} - 1))"
    rho = f"((sum({n} * ({bad} / {n} - {mean}) * ({bad} / {n} - {mean})) - {base} * ({k} - 1)) / ({base} * {gap}))"
    return (
        f"CASE WHEN {k} < 2 OR {base} <= 0 OR {gap} <= 0 THEN {DEFAULT_STRENGTH} WHEN {rho} <= 0 THEN {STRENGTHS[1]} "
        f"ELSE least(greatest(1 / {rho} - 1, {STRENGTHS[0]}), {STRENGTHS[1]}) END"
    )


def op2_sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in cases]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, cases, strict=True)) + " END"
    action = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, cases, strict=True)) + " END"
    level = lambda p: f"CASE WHEN regexp_matches(name, '{_ADDRESS}') THEN name ELSE regexp_replace(regexp_extract(name, '{p}', 0), '^\\.', '') END"
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH seen AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{up}', '{low}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
outcome AS (
  SELECT doc_id AS page_id, CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL),
sums AS (
  SELECT host, regexp_replace(host, '{_PORT}', '') AS name, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM seen LEFT JOIN outcome USING (page_id) WHERE host <> '' GROUP BY ALL),
every AS (
  SELECT host, n, bad, {level(_DOMAIN)} AS domain, {level(_SUFFIX)} AS suffix FROM sums),
hosts AS (SELECT * FROM every WHERE n > 0),
domains AS (SELECT domain, suffix, sum(n) AS dn, sum(bad) AS dbad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(dn) AS sn, sum(dbad) AS sbad FROM domains GROUP BY ALL),
root AS (SELECT (sum(sbad) + 1) / (sum(sn) + 2) AS p0 FROM suffixes),
top AS (SELECT coalesce(max(p0), 0.5) AS p0, {_sql_strength("sn", "sbad", "p0")} AS s0 FROM suffixes, root),
suffix_rate AS (SELECT suffix, (sbad + s0 * p0) / (sn + s0) AS p1 FROM suffixes, top),
domain_in AS (SELECT * FROM domains JOIN suffix_rate USING (suffix)),
s1 AS (SELECT suffix, {_sql_strength("dn", "dbad", "p1")} AS s1 FROM domain_in GROUP BY suffix),
domain_rate AS (SELECT domain, (dbad + s1 * p1) / (dn + s1) AS p2 FROM domain_in JOIN s1 USING (suffix)),
host_in AS (SELECT * FROM hosts JOIN domain_rate USING (domain)),
s2 AS (SELECT domain, {_sql_strength("n", "bad", "p2")} AS s2 FROM host_in GROUP BY domain),
above AS (
  SELECT host, n, bad, coalesce(p2, p1, p0) AS p2, coalesce(s2, s1, s0) AS s2
  FROM every LEFT JOIN (SELECT * FROM domain_rate JOIN s2 USING (domain)) USING (domain) LEFT JOIN (SELECT * FROM suffix_rate JOIN s1 USING (suffix)) USING (suffix), top),
posterior AS (SELECT host, n, s2 * p2 + bad AS a, s2 * (1 - p2) + n - bad AS b FROM above),
bounds AS (
  SELECT host, n::BIGINT AS n_labelled, a / (a + b) AS p_mean,
    greatest(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0.0) AS p_low
  FROM posterior)
SELECT page_id, host, path, {rule} AS rule,
  coalesce({action}, CASE WHEN p_low > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict,
  round(p_mean, 9) AS p_mean, round(p_low, 9) AS p_low, n_labelled
FROM seen LEFT JOIN bounds USING (host)
"""

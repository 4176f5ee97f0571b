"""URL filters: explicit rules, else an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host, registered domain and public suffix.
Each level gets a beta prior whose mean is the posterior mean of the level above, the member's
own labels left out so that none counts twice, and whose strength is estimated from how much
the rates of that level vary more than binomial noise.  A
host is blocked when the lower bound of its bad rate, under its posterior, passes the limit;
a host without labels has the posterior of its domain, suffix or of all pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.plans.lineage import cut_lineage

# Fixed values of the contract: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp",
              "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "com.ar", "com.sg")
#: Highest bad rate that is let through, and standard deviations of the bound.
LIMIT = 0.3
DEVIATIONS = 1.645
#: Bad rate taken for granted before any label is seen, and the number of labels it is worth.
PRIOR_BAD, PRIOR_LABELS = 0.05, 2
#: Bounds of a level's intraclass correlation: strengths from 1 to 10 000 labels.
LEAST_RHO, MOST_RHO = 1e-4, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: An IP address as a host.
ADDRESS = r"^([0-9]+([.][0-9]+){3}|\[.*\])$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, its port left out; an IP address (four
    numbers, or in brackets) is its own domain and suffix, so it shares nothing with others."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    listed = two.isin(*TWO_LABELS)
    domain = F.when(listed, F.substring_index(bare, ".", -3)).otherwise(two)
    suffix = F.when(listed, two).otherwise(F.substring_index(bare, ".", -1))
    address = bare.rlike(ADDRESS)
    return F.when(address, bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


def _strength(children: DataFrame) -> Column:
    """Prior strength of a level from rows ``(n, bad, mean)``, as a one-row aggregate."""
    m = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("mean")))
    spread = F.pow(F.col("bad") / F.col("n") - m, 2) * F.col("n") / (m * (1 - m))
    more = F.sum(F.col("n") - 1)
    rho = F.when(more > 0, (F.sum(spread) - F.count(F.lit(1))) / more).otherwise(F.lit(LEAST_RHO))
    rho = F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), F.coalesce(rho, F.lit(LEAST_RHO))))
    return (1 / rho - 1).alias("strength")


def _shrunk(df: DataFrame) -> DataFrame:
    """Adds ``a`` and ``b``, the posterior of each row under its prior mean, and ``post``."""
    one = df.where("n > 0").agg(_strength(df))  # one row
    s = F.col("strength")
    return (
        df.crossJoin(F.broadcast(one))  # one row of one number
        .withColumn("a", s * F.col("mean") + F.col("bad"))
        .withColumn("b", s * (1 - F.col("mean")) + F.col("n") - F.col("bad"))
        .withColumn("post", F.col("a") / (F.col("a") + F.col("b"))).drop("strength", "mean")
    )


def reputation(outcomes: DataFrame) -> DataFrame:
    """``(host, n, bad, a, b, post)`` for each host of ``outcomes(host, bad)``; ``bad`` is 0, 1
    or null where a page has no label."""
    domain, suffix = levels(F.col("host"))
    hosts = cut_lineage(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    )
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = total(hosts, "domain", "suffix")
    suffixes = total(domains, "suffix")
    bad, n = F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    a = bad + F.lit(PRIOR_BAD * PRIOR_LABELS)
    everything = hosts.agg(a.alias("pa"), (n + PRIOR_LABELS - a).alias("pb"))
    # the posterior of the level above, without the labels of the row itself
    rest = ((F.col("pa") - F.col("bad")) / (F.col("pa") + F.col("pb") - F.col("n"))).alias("mean")

    def under(rows: DataFrame) -> DataFrame:
        return _shrunk(rows.select("*", rest).drop("pa", "pb"))

    up = lambda df, key: df.select(key, F.col("a").alias("pa"), F.col("b").alias("pb"))
    by_suffix = under(suffixes.crossJoin(F.broadcast(everything)))  # one row of two numbers
    by_domain = under(domains.join(up(by_suffix, "suffix"), "suffix"))
    return under(hosts.join(up(by_domain, "domain"), "domain")).select("host", "n", "bad", "a", "b", "post")


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
    limit: float = LIMIT, deviations: float = DEVIATIONS,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages(page_id, url)``.

    ``outcomes(page_id, bad)`` are the labelled pages; several labels of a page count once, by
    their maximum, null ones not at all.  A rule decides where one fits, the reputation of the
    host elsewhere.  A null URL, or one without ``://``, belongs to the empty host.  Rows with
    null or repeated ids are kept; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    known = (
        outcomes.where("page_id IS NOT NULL").select(F.col("page_id").alias("_id"), F.col("bad").cast("long").alias("bad"))
        .groupBy("_id").agg(F.max("bad").alias("bad"))
    )
    rows = cut_lineage(
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .join(known, F.col("page_id") == F.col("_id"), "left").drop("_id")
    )
    mean = F.col("post")
    bound = mean - deviations * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    judged = reputation(rows.select("host", "bad")).select("host", (bound > limit).alias("_bad_host"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.join(judged, "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_bad_host"), "block").otherwise("allow")).alias("verdict"),
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages: the number at the start of a path segment names the document that the
    page shows; it is bad if that document is of low quality or toxic."""
    _, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, "/([0-9]{1,18})(?:[./]|$)", 1)
    shown = pages.select("page_id", F.when(number != "", number.cast("long")).alias("_doc")).where("_doc IS NOT NULL")
    bad = labels.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    )
    return shown.join(bad, "_doc").select("page_id", "bad")


SQL = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), lab AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), v AS (
  SELECT u.*, lab.bad FROM u LEFT JOIN lab
    ON try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1), '') AS BIGINT) = lab.doc_id AND page_id IS NOT NULL
), h0 AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(host, ':[0-9]*$', '') AS bare FROM v GROUP BY host
), h1 AS (
  SELECT host, n, bad, array_to_string(string_split(bare, '.')[-2:], '.') AS two, bare FROM h0
), h AS (
  SELECT host, n, bad,
    CASE WHEN regexp_matches(bare, '{ADDRESS}') THEN bare WHEN two IN {TWO_LABELS} THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE two END AS domain,
    CASE WHEN regexp_matches(bare, '{ADDRESS}') THEN bare WHEN two IN {TWO_LABELS} THEN two ELSE string_split(bare, '.')[-1] END AS suffix FROM h1
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL
), g AS (SELECT coalesce(sum(bad), 0) + {PRIOR_BAD * PRIOR_LABELS} AS pa, coalesce(sum(n), 0) + {PRIOR_LABELS} AS pn FROM h
), sm AS (SELECT *, greatest(1e-6, least(1 - 1e-6, mean)) AS m FROM (SELECT s.*, (pa - bad) / (pn - n) AS mean FROM s, g)
), sr AS (SELECT 1 / greatest({LEAST_RHO}, least({MOST_RHO}, coalesce(CASE WHEN sum(n - 1) > 0
            THEN (sum(pow(bad / n - m, 2) * n / (m * (1 - m))) - count(*)) / sum(n - 1) END, {LEAST_RHO}))) - 1 AS k FROM sm WHERE n > 0
), sp AS (SELECT suffix, k * mean + bad AS pa, k + n AS pn FROM sm, sr
), dm AS (SELECT *, greatest(1e-6, least(1 - 1e-6, mean)) AS m FROM (SELECT d.*, (pa - bad) / (pn - n) AS mean FROM d JOIN sp USING (suffix))
), dr AS (SELECT 1 / greatest({LEAST_RHO}, least({MOST_RHO}, coalesce(CASE WHEN sum(n - 1) > 0
            THEN (sum(pow(bad / n - m, 2) * n / (m * (1 - m))) - count(*)) / sum(n - 1) END, {LEAST_RHO}))) - 1 AS k FROM dm WHERE n > 0
), dp AS (SELECT domain, k * mean + bad AS pa, k + n AS pn FROM dm, dr
), hm AS (SELECT *, greatest(1e-6, least(1 - 1e-6, mean)) AS m FROM (SELECT h.*, (pa - bad) / (pn - n) AS mean FROM h JOIN dp USING (domain))
), hr AS (SELECT 1 / greatest({LEAST_RHO}, least({MOST_RHO}, coalesce(CASE WHEN sum(n - 1) > 0
            THEN (sum(pow(bad / n - m, 2) * n / (m * (1 - m))) - count(*)) / sum(n - 1) END, {LEAST_RHO}))) - 1 AS k FROM hm WHERE n > 0
), hp AS (SELECT host, k + n AS total, (k * mean + bad) / (k + n) AS mean FROM hm, hr
), judged AS (SELECT host, mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (total + 1)) > {LIMIT} AS bad_host FROM hp
), r AS (
  SELECT page_id, u.host, path, CASE
    WHEN (u.host = 'example.net' OR u.host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (u.host = 'example.com' OR u.host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (u.host = 'org' OR u.host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (u.host = 'net' OR u.host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN bad_host THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN judged USING (host)
"""

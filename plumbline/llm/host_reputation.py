"""URL filter: empirical-Bayes host reputation under explicit rules.

Labelled page outcomes (bad or not) are counted by host, and shrunk through beta-binomial priors: the suffix's rate is
drawn to the global rate, the registered domain's to its suffix's, the host's to its registered domain's. Each level has a
prior strength of its own, from the spread of its members within their parents (see ``shrinkage``). A host is blocked if
the lower posterior bound of its bad rate is above ``block_lift`` times the global rate, that is, if its pages are worse
than the average page's beyond doubt; a host without labels has its parents' posterior.
Explicit rules go first: a rule ``host/path`` fits its host and all subdomains if the url's path starts with its path,
and the longest rule that fits decides.

The suffix of a host is the longest of its ends that is in ``suffixes``, else its last label; the registered domain has
one label more. ``suffixes`` may be the whole public list: ends are looked up in a set.

Counts are grouped with partial aggregates, and verdicts of hosts with over a thousandth of all pages are broadcast, so a
host with a third of all pages costs no task more than a row for each map task; only the url, the id and the labels are read.

Defined cases: null url, or one without ``://``: host and path are empty, and the empty host is judged like any other;
null label: not counted; no labels at all: the global rate is 1/2 and nothing is blocked; labels of ids that aren't in
the pages are dropped; of several labels of an id the worst counts; repeated rows count each; null ids have no label;
other columns are not used; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, quoted, stored
from .shrinkage import shrunk, strengths

#: The rules of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART = "://([^/?#]*)([^?#]*)"
#: Suffixes of more than one label, as far as no list is given; labels of a suffix at most.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "com.br", "com.cn", "co.in", "co.kr", "co.za")
LABELS = 4
Z, BLOCK_LIFT = 1.645, 1.0


def url_parts(url: str) -> tuple[Column, Column]:
    host = F.coalesce(F.translate(F.regexp_extract(F.col(quoted(url)), PART, 1), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(F.col(quoted(url)), PART, 2), F.lit(""))


def rule_for(host: str, path: str, rules) -> Column:
    """The longest rule (then the first in order of text) that fits, as struct(rule, verdict); null if none does."""
    pick = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & F.col(path).startswith(slash + rest)
        pick = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(pick)
    return pick


def site_levels(host: str, suffixes) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host."""
    end = lambda k: F.substring_index(F.col(host), ".", -k)
    suffix, domain = end(1), end(2)
    for k in range(2, LABELS + 1):
        listed = end(k).isin(*[s for s in suffixes if s.count(".") == k - 1]) if any(s.count(".") == k - 1 for s in suffixes) else F.lit(False)
        suffix, domain = F.when(listed, end(k)).otherwise(suffix), F.when(listed, end(k + 1)).otherwise(domain)
    return domain, suffix


def reputations(outcomes: DataFrame, suffixes=SUFFIXES, z: float = Z, block_lift: float = BLOCK_LIFT) -> DataFrame:
    """``outcomes`` (host, n labelled, bad) -> its columns and mean, lower, blocked. The number of suffixes, domains and
    hosts is far below that of pages, but isn't bounded: they are joined, not collected."""
    domain, suffix = site_levels("host", suffixes)
    hosts = outcomes.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    level = lambda df, k, parent: df.select(F.lit(k).alias("level"), parent.alias("parent"), "n", F.col("bad").alias("s"), F.col("bad").cast("double").alias("q"))
    k = strengths(level(ends, 1, F.lit("")).unionByName(level(domains, 2, F.col("suffix"))).unionByName(level(hosts, 3, F.concat_ws(" ", "domain", "suffix"))))
    n, bad = ends.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    rate = bad / n if n else 0.5
    mean = lambda i, parent: shrunk(F.col("bad"), F.col("n"), F.lit(k.get(i, 1.0)), parent)
    ends = ends.select("suffix", mean(1, F.lit(rate)).alias("of_suffix"))
    domains = domains.join(ends, "suffix").select("suffix", "domain", mean(2, F.col("of_suffix")).alias("of_domain"))
    out = hosts.join(domains, ["suffix", "domain"]).withColumn("mean", mean(3, F.col("of_domain")))
    lower = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(k.get(3, 1.0) + 1)))
    return out.withColumn("lower", lower).select(*outcomes.columns, "mean", "lower", (F.col("lower") > block_lift * rate).alias("blocked"))


def page_outcomes(pages: DataFrame, labels: DataFrame, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id and bad: what ``labels`` (doc_id, bad) say of the document whose number is the second part of the path."""
    number = F.regexp_extract(url_parts(url)[1], "^/[^/]*/([0-9]{1,18})", 1)
    shown = pages.select(F.col(quoted(page_id)).alias("page_id"), F.when(number != "", number).cast("long").alias("doc_id"))
    return shown.join(labels.select("doc_id", "bad"), "doc_id").select("page_id", "bad")


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, suffixes=SUFFIXES, url: str = "url", page_id: str = "page_id", **options) -> DataFrame:
    """``labels``: page_id and bad (0/1, null: unknown). Returns page_id, host, path, rule, verdict, and of the host n
    (labelled pages), bad, mean and lower (the posterior's)."""
    host, path = url_parts(url)
    rows = pages.select(F.col(quoted(page_id)).alias("page_id"), host.alias("host"), path.alias("path"))
    known = labels.select(F.col("page_id").alias("_id"), F.col("bad").cast("long").alias("_bad")).where("_bad IS NOT NULL").groupBy("_id").agg(F.max("_bad").alias("_bad"))
    seen = rows.join(known, rows.page_id == known._id, "left").groupBy("host").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("pages"))
    rated = stored(reputations(stored(seen, "hosts"), suffixes, **options), "reputations")
    total = rated.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    out = joined_by_key(rows, rated, "host", "pages", total).withColumn("_rule", rule_for("host", "path", rules))
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), "n", "bad", "mean", "lower")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
k AS (SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad
  FROM p JOIN labels ON try_cast(regexp_extract(path, '^/[^/]*/([0-9]{1,18})', 1) AS BIGINT) = doc_id GROUP BY page_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM p LEFT JOIN k USING (page_id) GROUP BY host),
h1 AS (SELECT *, string_split(host, '.') AS l FROM h0),
h2 AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ('example.com', 'example.net', 'example.org') THEN 2 ELSE 1 END AS m FROM h1),
h AS (SELECT host, n, bad, array_to_string(l[-m:], '.') AS suffix, array_to_string(l[-(m + 1):], '.') AS domain FROM h2),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
l AS (SELECT 1 AS lv, '' AS parent, n::DOUBLE AS n, bad::DOUBLE AS b FROM s UNION ALL SELECT 2, suffix, n, bad FROM d UNION ALL SELECT 3, domain || ' ' || suffix, n, bad FROM h),
g AS (SELECT lv, parent, sum(n) AS n, sum(b) AS b, sum(n * n) AS nn, count(*) AS h, sum(b * b / n) AS bb, sum(b - b * b / n) AS w FROM l WHERE n > 0 GROUP BY ALL),
a AS (SELECT lv, sum(bb - b * b / n) AS sb, sum(w) AS sw, sum(h) - count(*) AS db, sum(n) - sum(h) AS dw, sum(n) - sum(nn / n) AS c FROM g GROUP BY lv),
v AS (SELECT lv, CASE WHEN db > 0 AND dw > 0 AND sb / db + (c / db - 1) * sw / dw > 0 THEN least(greatest((sb / db - sw / dw) / (sb / db + (c / db - 1) * sw / dw), 0.0001), 0.5) ELSE 0.0001 END AS rho FROM a),
q AS (SELECT max(CASE WHEN lv = 1 THEN 1 / rho - 1 END) AS k1, max(CASE WHEN lv = 2 THEN 1 / rho - 1 END) AS k2, max(CASE WHEN lv = 3 THEN 1 / rho - 1 END) AS k3 FROM v),
r AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n)::DOUBLE ELSE 0.5 END AS rate FROM s),
s2 AS (SELECT suffix, (bad + k1 * rate) / (n + k1) AS ms FROM s, q, r),
d2 AS (SELECT d.suffix, domain, (bad + k2 * ms) / (n + k2) AS md FROM d JOIN s2 USING (suffix), q),
m AS (SELECT host, n, bad, (bad + k3 * md) / (n + k3) AS mean, k3 FROM h JOIN d2 USING (suffix, domain), q),
b AS (SELECT *, mean - 1.645 * sqrt(mean * (1 - mean) / (n + k3 + 1)) AS lower FROM m),
j AS (SELECT p.*, n, bad, mean, lower, lower > rate AS blocked, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p JOIN b USING (host), r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict,
  n, bad, round(mean, 6) AS mean, round(lower, 6) AS lower FROM j
"""

"""URL rules and empirical-Bayes host reputation, in DataFrame functions only.

Explicit rules decide first. Other pages follow the reputation of their host:
the rate of bad pages, shrunk through beta-binomial priors from host to
registered domain to suffix to all pages. A host is blocked when the lower
bound of its posterior rate, a quantile of the beta distribution, reaches
BLOCK_AT. Outcomes of pages are given by the caller. Where nobody has labelled
pages, but documents are labelled, fit_outcome() learns from these how much junk
a bad text has, and page_outcomes() holds the visible text of pages against it;
the names of hosts play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, written

#: (verdict, host, path); the longest that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn", "co.za")
Z, BLOCK_AT = 1.645, 0.3
#: Prior weights, in pages, that an estimate is held between.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 200.0
#: Characters that count as junk, and what of a page is not visible text.
JUNK = "[#*$%&|<>]"
MARKUP = "<script[^>]*>[^<]*|<style[^>]*>[^<]*|<[^>]*>"
SALTS = 16
LEVELS = ("suffix", "domain", "host")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def junk_share(text: Column) -> Column:
    """Junk characters in a thousand, rounded down; null for a null text."""
    return F.floor(F.regexp_count(text, F.lit(JUNK)) * 1000 / F.greatest(F.length(text), F.lit(1))).cast("int")


def fit_outcome(docs: DataFrame, labels: DataFrame, column: str = "quality") -> int:
    """The junk share from which on a text counts as bad, by labelled documents (label 0 is bad).

    It is the one with the best balanced accuracy, the largest of equal ones; a
    share that no text has (1001) without labels of both kinds. Documents with a
    null text do not count; of conflicting labels of an id the smaller counts.
    At most 1001 counts come to the driver.
    """
    own = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(F.min(column).alias("label")).where("label is not null")
    texts = docs.select(F.col("doc_id").alias("doc_id"), junk_share(F.col("text")).alias("share")).where("share is not null")
    rows = texts.join(own, "doc_id").groupBy("share").agg(F.sum((F.col("label") == 0).cast("long")).alias("bad"), F.count("*").alias("n")).collect()
    bad, good = sum(r.bad for r in rows), sum(r.n - r.bad for r in rows)
    if not bad or not good:
        return 1001
    right = lambda t: sum(r.bad for r in rows if r.share >= t) * good + sum(r.n - r.bad for r in rows if r.share < t) * bad
    return max(range(1, 1002), key=lambda t: (right(t), t))


def page_outcomes(pages: DataFrame, least: int) -> DataFrame:
    """url and bad (1 or 0; null for a page without html) by the junk share of the visible text."""
    visible = F.regexp_replace("html", MARKUP, " ")
    return pages.select("url", (junk_share(visible) >= least).cast("int").alias("bad"))


def beta_bound(a: Column, b: Column) -> Column:
    """About the 5 % quantile of the beta distribution with a and b (Abramowitz and Stegun 26.5.22).

    Within 0.01 for a + b of 3 or more, as there are with a prior and a page.
    It is 0 where a is 0.5 or less, and where b is below 1.5 that of 1.5, which
    is lower.
    """
    b = F.greatest(b, F.lit(1.5))
    x, y = 1 / (2 * F.greatest(a, F.lit(0.5001)) - 1), 1 / (2 * b - 1)
    h, bend = 2 / (x + y), (Z * Z - 3) / 6
    w = Z * F.sqrt(h + bend) / h - (y - x) * (bend + 5 / 6 - 2 / (3 * h))
    return F.when((a <= 0.5) | (h + bend <= 0), 0.0).otherwise(a / (a + b * F.exp(2 * w)))


def suffix_of(host: Column) -> Column:
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.regexp_extract(bare, r"([^.]*)$", 1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label before it; a host without such a label is its own domain."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    label = F.regexp_extract(F.substring(bare, F.lit(1), F.length(bare) - F.length(suffix) - 1), r"([^.]+)$", 1)
    return F.when(label != "", F.concat(label, F.lit("."), suffix)).otherwise(bare)


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, bound) of the hosts in outcomes (host, bad 0/1 or null); unlabelled rows and the empty host do not count.

    A member's prior has the rate of its parent as mean and a weight by the
    method of moments of the beta-binomial distribution: how much the level's
    members vary about their parents, beyond what their counts explain. The
    bound is the 5 % quantile of the posterior, see beta_bound().
    """
    hosts = outcomes.where(F.col("bad").isNotNull() & (F.col("host") != "")).groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = written(hosts, "host-outcomes")  # one pass over the pages serves every level
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (every["bad"] + 0.5) / (every["n"] + 1) if every["n"] else 0.5

    def weight(level: DataFrame) -> float:
        """level: n, bad and prior, the mean that its parent gives."""
        noise, off = F.col("prior") * (1 - F.col("prior")), F.col("bad") / F.col("n") - F.col("prior")
        r = level.agg(F.sum(F.col("n") * off * off).alias("v"), F.sum(noise).alias("least"), F.sum(F.col("n") * noise).alias("most")).first()
        if r["v"] is None or r["most"] - r["least"] <= 1e-9:
            return MOST_WEIGHT
        alike = max((r["v"] - r["least"]) / (r["most"] - r["least"]), 1e-9)
        return float(min(max(1 / alike - 1, LEAST_WEIGHT), MOST_WEIGHT))

    def shrunk(level: DataFrame, k: float) -> Column:
        return (level["bad"] + k * level["prior"]) / (level["n"] + k)

    suffixes = suffixes.withColumn("prior", F.lit(mean))
    by_suffix = suffixes.select("suffix", shrunk(suffixes, weight(suffixes)).alias("prior"))
    domains = domains.join(by_suffix, "suffix")
    by_domain = domains.select("domain", shrunk(domains, weight(domains)).alias("prior"))
    hosts = hosts.join(by_domain, "domain")
    k = weight(hosts)
    hosts = hosts.withColumn("rate", shrunk(hosts, k))
    weight_of = F.col("n") + k
    return hosts.withColumn("bound", beta_bound(F.col("rate") * weight_of, (1 - F.col("rate")) * weight_of)).select("host", "n", "bad", "rate", "bound")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, block_at: float = BLOCK_AT) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each page, repeated and null ids too.

    outcomes (url, bad: 1, 0 or null for unknown) are labelled pages, which need
    not be among pages. Pages of unknown or empty hosts are allowed unless a
    rule blocks them. Urls may be of any length; of fitting rules the longest
    wins, of equally long ones the later. Rows meet the blocked hosts by host
    and a salt, so one host may hold most pages. An empty table gives none;
    other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    own = outcomes.select(host.alias("host"), "bad")
    known = reputations(own)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    blocked = known.where(F.col("bound") >= block_at).select(F.col("host").alias("bad_host"), salts.alias("bad_salt"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    out = own.join(blocked, (F.col("host") == F.col("bad_host")) & (F.col("salt") == F.col("bad_salt")), "left")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def _sql_reputation() -> str:
    bare = "regexp_replace(host, ':[0-9]*$', '')"
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    fits = "\n".join(
        f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in enumerate(sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    )
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE\n" + fits.format(*(h + p for _, h, p in ordered)) + " END"
    verdict = "CASE\n" + fits.format(*(v for v, _, _ in ordered)) + " END"

    def share(text: str) -> str:
        return f"floor(len(regexp_extract_all({text}, '{JUNK}')) * 1000 / greatest(length({text}), 1))"

    def weight(level: str) -> str:
        """Of a table with n, bad and prior."""
        noise = "prior * (1 - prior)"
        return f"""(SELECT CASE WHEN sum(n * {noise}) - sum({noise}) <= 1e-9 OR count(*) = 0 THEN {MOST_WEIGHT} ELSE
      least(greatest(1 / greatest((sum(n * power(bad / n - prior, 2)) - sum({noise})) / (sum(n * {noise}) - sum({noise})), 1e-9) - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) END FROM {level})"""

    return f"""
WITH parted AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
own AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parted),
labelled AS (
  SELECT {share("text")} AS share, label FROM documents
  JOIN (SELECT doc_id, min(quality) AS label FROM labels GROUP BY doc_id HAVING min(quality) IS NOT NULL) USING (doc_id) WHERE text IS NOT NULL),
sizes AS (SELECT count(*) FILTER (label = 0) AS n_bad, count(*) FILTER (label <> 0) AS n_good FROM labelled),
least AS (
  SELECT coalesce(arg_max(t, (found, t)), 1001) AS least FROM (
    SELECT t, any_value(n_good) * count(*) FILTER (label = 0 AND share >= t) + any_value(n_bad) * count(*) FILTER (label <> 0 AND share < t) AS found
    FROM range(1, 1002) AS r(t), labelled, sizes WHERE n_bad > 0 AND n_good > 0 GROUP BY t)),
outcomes AS (
  SELECT host, CASE WHEN visible IS NOT NULL THEN ({share("visible")} >= least)::INTEGER END AS bad
  FROM (SELECT host, regexp_replace(html, '{MARKUP}', ' ', 'g') AS visible FROM own WHERE host <> ''), least),
hosts0 AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM outcomes WHERE bad IS NOT NULL GROUP BY host),
hosts1 AS (SELECT *, {bare} AS bare, regexp_extract({bare}, '([^.]+\\.[^.]+)$', 1) AS two FROM hosts0),
hosts2 AS (SELECT *, CASE WHEN two IN ({two}) THEN two ELSE regexp_extract(bare, '([^.]*)$', 1) END AS suffix FROM hosts1),
hosts3 AS (SELECT *, regexp_extract(substr(bare, 1, greatest(length(bare) - length(suffix) - 1, 0)), '([^.]+)$', 1) AS label FROM hosts2),
hosts AS (SELECT host, n, bad, suffix, CASE WHEN label <> '' THEN label || '.' || suffix ELSE bare END AS domain FROM hosts3),
domains0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains0 GROUP BY ALL),
overall AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5) / (sum(n) + 1) ELSE 0.5 END AS mean FROM suffixes0),
suffixes AS (SELECT s.*, mean AS prior FROM suffixes0 s, overall),
ks AS (SELECT {weight("suffixes")} AS k),
domains AS (SELECT d.*, (s.bad + k * s.prior) / (s.n + k) AS prior FROM domains0 d JOIN suffixes s USING (suffix), ks),
kd AS (SELECT {weight("domains")} AS k),
priors AS (SELECT h.*, (d.bad + k * d.prior) / (d.n + k) AS prior FROM hosts h JOIN domains d USING (domain), kd),
kh AS (SELECT {weight("priors")} AS k),
by_host AS (SELECT host, bad + k * prior AS a, greatest(n - bad + k * (1 - prior), 1.5) AS b FROM priors, kh),
halves AS (SELECT *, 1 / (2 * greatest(a, 0.5001) - 1) AS x, 1 / (2 * b - 1) AS y, {(Z * Z - 3) / 6} AS bend FROM by_host),
bounds AS (SELECT *, 2 / (x + y) AS h FROM halves),
blocked AS (
  SELECT host FROM bounds WHERE a > 0.5 AND h + bend > 0
  AND a / (a + b * exp(2 * ({Z} * sqrt(greatest(h + bend, 0)) / h - (y - x) * (bend + 5.0 / 6 - 2 / (3 * h))))) >= {BLOCK_AT})
SELECT page_id, host, path, {rule} AS rule,
  coalesce({verdict}, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM own"""


SQL = _sql_reputation()

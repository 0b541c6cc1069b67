"""URL filters with DataFrame functions alone: rules, then empirical-Bayes host reputation.

Labelled outcomes of pages (bad or not) are counted for hosts, registered domains and suffixes. The share of bad pages is
shrunk downwards through beta-binomial priors: a suffix's towards the overall share, a domain's towards its suffix's, a
host's towards its domain's. The strength of each level's prior is estimated from how much shares of that level differ from
their parents' beyond binomial noise (method of moments). A page is blocked if the lower bound of its host's posterior share
of bad pages (mean - Z standard deviations) is above LIMIT. The page's own outcome is taken out of its host's counts first,
so no page is judged by its own label; a host without other labels has its domain's prior as posterior.

A host's name is the host without user and port. Its suffix is the last label, or one of LONG_SUFFIXES; its domain has one
label more. An address of numbers or in brackets is its own domain and suffix.

Hosts are counted once, into a stored table; a host with a third of all pages is counted by partial sums and joined back by
Spark's skew-splitting joins, or by broadcast while hosts are few. Null urls and urls without `://` have an empty host and
path; the empty host is a host like others. Rows are kept one by one: repeated and null page ids are fine. Outcomes other
than 0 and 1 are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import Scratch, col, table

Z, LIMIT, BROADCAST_HOSTS = 1.645, 0.5, 1 << 19
LEAST, MOST = 0.002, 0.5  # bounds of the intra-group correlation that the moments may give
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules asked for, suffixes of two labels, and words that mark an unwanted page's address.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn", "co.za")
SPAM_WORDS = ("casino", "bets", "poker", "slots", "jackpot", "pills", "viagra", "adult", "porn", "xxx", "escort", "spam", "ads", "malware", "phishing", "warez", "torrents", "payday")
_ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}\z|\[)"


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, domain and suffix added, in place of any columns of these names."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    source = F.coalesce(col(url).cast("string"), F.lit(""))
    out = pages.drop(*({"host", "path", "domain", "suffix"} - {url})).withColumns({"host": F.translate(F.regexp_extract(source, pattern, 1), UPPER, LOWER), "path": F.regexp_extract(source, pattern, 2)})
    name = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r"(?<=[^:]):[0-9]*\z", "")
    tail = lambda n: F.substring_index(name, ".", -n)
    long, address = tail(2).isin(*LONG_SUFFIXES), name.rlike(_ADDRESS)
    return out.withColumns({"suffix": F.when(address, name).when(long, tail(2)).otherwise(tail(1)), "domain": F.when(address, name).when(long, tail(3)).otherwise(tail(2))})


def ruled(rules=RULES) -> Column:
    """The rule (rule, action) that fits host and path and is longest, ties to the smaller text; null if none. rules: a fixed list."""
    fits = [F.lit(None).cast("struct<length:int,rule:string,action:string>")]
    for host, path, action in rules:
        fit = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        fits.append(F.when(fit, F.struct(F.lit(-len(host + path)).alias("length"), F.lit(host + path).alias("rule"), F.lit(action).alias("action"))))
    return F.array_min(F.array_compact(F.array(*fits)))


def _strength(level: DataFrame) -> float:
    """The prior's strength from rows (n, k, mu): E[n (k/n - mu)^2 / (mu (1 - mu))] = 1 + (n - 1) rho; one number to the driver."""
    q = F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("mu"), 2) / (F.col("mu") * (1 - F.col("mu")))
    row = level.filter("n > 0").agg(F.sum(q).alias("q"), F.count("*").alias("c"), F.sum(F.col("n") - 1).alias("more")).first()
    rho = (row.q - row.c) / row.more if row.c and row.more else LEAST
    return 1 / min(max(rho, LEAST), MOST) - 1


def priors(pages: DataFrame) -> DataFrame:
    """pages: host, domain, suffix and bad (1, 0 or null where not labelled). (host, a, b): each host's posterior Beta(a, b) by all its labels."""
    scratch = Scratch(pages)
    hosts = scratch.put(pages.groupBy("host", "domain", "suffix").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")), "hosts")
    domains = scratch.put(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = domains.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    share = (total[1] + 0.5) / (total[0] + 1)
    level = suffixes.withColumn("mu", F.lit(share))
    for below, key in ((domains, "suffix"), (hosts, "domain")):
        m = _strength(level)
        parent = level.select(key, ((F.col("k") + m * F.col("mu")) / (F.col("n") + m)).alias("mu"))
        level = scratch.put(below.join(parent, key), "level")
    m = _strength(level)
    return level.select("host", (F.col("k") + m * F.col("mu")).alias("a"), (F.col("n") - F.col("k") + m * (1 - F.col("mu"))).alias("b"))


def bound(a: Column, b: Column) -> Column:
    """The lower bound of the share that has the distribution Beta(a, b)."""
    return a / (a + b) - Z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))


def judge(pages: DataFrame, outcomes: DataFrame | None = None, page_id: str = "page_id", url: str = "url", bad: str | None = None, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) for each page. Outcomes are a column `bad` of pages, or a table of page_id and bad (1, 0; a page labelled twice is bad if any label is)."""
    mark = col(bad) if bad is not None else F.lit(None)
    placed = with_host(pages.select(col(page_id).alias("page_id"), col(url).alias("url"), mark.cast("int").alias("bad")))
    if outcomes is not None:
        marks = outcomes.filter("page_id is not null and bad in (0, 1)").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
        placed = placed.drop("bad").join(marks, "page_id", "left")
    placed = placed.select("page_id", "host", "path", "domain", "suffix", F.when(F.col("bad").isin(0, 1), F.col("bad")).alias("bad"))
    known = priors(placed.select("host", "domain", "suffix", "bad"))
    out = placed.join(F.broadcast(known) if known.count() <= BROADCAST_HOSTS else known, "host", "left").withColumn("r", ruled(rules))
    own = bound(F.col("a") - F.coalesce("bad", F.lit(0)), F.col("b") - F.coalesce(1 - F.col("bad"), F.lit(0)))
    out = out.withColumn("bound", own)
    method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", method).alias("verdict"), "bound")


def spam_words(url: Column) -> Column:
    """1 where a word of the address (split at all but a-z, A-Z and 0-9) is one of SPAM_WORDS, 0 elsewhere, null for a null address."""
    return F.arrays_overlap(F.split(F.translate(url, UPPER, LOWER), "[^0-9a-z]+"), F.array(*(F.lit(w) for w in SPAM_WORDS))).cast("int")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: pages have no labels of their own in the tables, so words of each page's own address mark it as bad or not."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages.withColumn("bad", spam_words(F.col("url"))), bad="bad").drop("bound")


OP10_SQL = rf"""
WITH p AS (
  SELECT page_id, CAST(list_has_any(regexp_split_to_array(translate(url, '{UPPER}', '{LOWER}'), '[^0-9a-z]+'), {list(SPAM_WORDS)}) AS INT) AS bad,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
s AS (
  SELECT page_id, bad, host, path, CASE WHEN ip THEN name ELSE array_to_string(l[-t:], '.') END AS suffix, CASE WHEN ip THEN name ELSE array_to_string(l[-t - 1:], '.') END AS domain
  FROM (
    SELECT *, string_split(name, '.') AS l, CASE WHEN array_to_string(string_split(name, '.')[-2:], '.') IN {LONG_SUFFIXES} THEN 2 ELSE 1 END AS t, regexp_matches(name, '{_ADDRESS}') AS ip
    FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '([^:]):[0-9]*\z', '\1') AS name FROM p))),
h AS (SELECT host, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM s GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (sum(sum(k)) OVER () + 0.5) / (sum(sum(n)) OVER () + 1) AS mu FROM d GROUP BY ALL),
mx AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - mu) ** 2 / (mu * (1 - mu))) - count(*)) / nullif(sum(n - 1), 0), {LEAST}), {LEAST}), {MOST}) - 1 AS m FROM x WHERE n > 0),
d2 AS (SELECT d.*, (x.k + m * mu) / (x.n + m) AS mu FROM d JOIN x USING (suffix), mx),
md AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - mu) ** 2 / (mu * (1 - mu))) - count(*)) / nullif(sum(n - 1), 0), {LEAST}), {LEAST}), {MOST}) - 1 AS m FROM d2 WHERE n > 0),
h2 AS (SELECT h.*, (d2.k + m * d2.mu) / (d2.n + m) AS mu FROM h JOIN d2 USING (domain), md),
mh AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - mu) ** 2 / (mu * (1 - mu))) - count(*)) / nullif(sum(n - 1), 0), {LEAST}), {LEAST}), {MOST}) - 1 AS m FROM h2 WHERE n > 0),
post AS (SELECT host, k + m * mu AS a0, n - k + m * (1 - mu) AS b0 FROM h2, mh),
rules(host, path, action) AS (VALUES {", ".join(map(str, RULES))}),
fit AS (
  SELECT s.page_id, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS i
  FROM s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)),
own AS (SELECT s.*, a0 - coalesce(bad, 0) AS a, b0 - coalesce(1 - bad, 0) AS b FROM s LEFT JOIN post ON post.host = s.host)
SELECT own.page_id, own.host, own.path, fit.rule, coalesce(fit.action, CASE WHEN a / (a + b) - {Z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN fit ON fit.page_id = own.page_id AND fit.i = 1
"""

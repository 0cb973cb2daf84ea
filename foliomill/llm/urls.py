"""URL filters: host-suffix and path-prefix expressions, joined to rules on short digest prefixes.

Every url is expanded into the suffixes of its host and the prefixes of its path that have a label
count and a length some rule has, so an odd url with thousands of labels expands no further than a
plain one.  Expressions meet the rules by an equi-join on the first four bytes of their SHA-256; the
full digests confirm, and the longest fitting rule wins (a block before an allow of the same length).
Urls without a rule are judged by their host: a host one of whose names is spam vocabulary is blocked,
any other is allowed.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; equal
urls are judged once and the verdict is joined back, so a url that a third of all pages share is one
row of the matching; rows are neither dropped nor merged; an empty rule table leaves the host verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import common

# The rules of the query, as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Names in a host that mark unwanted sites.
SPAM_NAMES = "adult|ads|bets|casino|cheap|farm|gambling|pills|porn|spam|track|viagra"
RULE_ROWS = 100_000


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(common.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules=RULES) -> DataFrame:
    """verdict, host, path -> also rule (as written), digest, short, width."""
    rows = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    rule = F.concat("host", "path")
    return rows.select("verdict", "host", "path", rule.alias("rule"), F.sha2(F.concat_ws("\x01", "host", "path"), 256).alias("digest")).withColumn("short", F.substring("digest", 1, 8))


def expressions(hosts: Column, paths: Column, labels: list[int], lengths: list[int]) -> Column:
    """Digests of the host suffixes with so many labels, each with the path prefixes of these lengths."""
    names = F.split(hosts, r"\.", -1)
    suffixes = F.array(*(F.when(F.size(names) >= n, F.substring_index(hosts, ".", -n)) for n in labels))
    prefixes = F.array(*(F.when(F.char_length(paths) >= n, F.substring(paths, 1, n)) for n in lengths))
    both = F.flatten(F.transform(F.filter(suffixes, lambda s: s.isNotNull() & (s != "")), lambda s: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.sha2(F.concat_ws("\x01", s, p), 256))))
    return both


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, decided_by."""
    shape = rules.select(F.size(F.split("host", r"\.", -1)).alias("labels"), F.char_length("path").alias("length")).agg(F.collect_set("labels").alias("a"), F.collect_set("length").alias("b")).first()
    urls = pages.select("url").where("url IS NOT NULL").distinct().select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    spam = F.col("host").rlike(rf"(^|[.-])({SPAM_NAMES})([.-]|$)")
    asked = urls.where("host <> ''").select("url", F.explode(expressions(F.col("host"), F.col("path"), sorted(shape.a), sorted(shape.b))).alias("mine"))
    known = common.small_side(rules.select("rule", "verdict", "digest", "short"), RULE_ROWS)
    fits = asked.withColumn("short", F.substring("mine", 1, 8)).join(known, "short").where("mine = digest")
    best = fits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.char_length("rule"), F.col("verdict") == "block", "rule")).alias("best"))
    judged = urls.join(best, "url", "left").select(
        F.col("url").alias("_url"), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(spam, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("best").isNotNull(), "rule").otherwise("host").alias("decided_by"),
    )
    back = pages.select("page_id", "url").join(judged, F.col("url") == F.col("_url"), "left")
    return back.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.coalesce("decided_by", F.lit("host")).alias("decided_by"))


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir, "pages"), rule_table(spark))


OP5_SQL = rf"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{common.UPPER}', '{common.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|[.-])({SPAM_NAMES})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' ELSE 'host' END AS decided_by
FROM ruled
"""

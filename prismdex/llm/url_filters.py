"""URL rules by host suffix and path prefix, matched as an equi-join on short hash prefixes.

Each distinct host is expanded into every host suffix that begins at a label; suffixes meet the hosts of rules, which say how long the paths
of their rules are.  Each distinct host and path is then expanded into those suffixes and the path prefixes of these lengths, as
expressions like ``example.net/en/``.  Both times the join is on the first 4 bytes of a SHA-256 and the full digest confirms a match;
the longest rule that is left decides.  No list of rules or lengths goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismdex.llm.tables import table

#: (verdict, host, path): fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("\n", *parts), 256))


def _meet(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows with equal digests in column ``on``: an equi-join on their first 4 bytes alone, whose matches are confirmed by the full digests of each prefix (one, but for chance)."""
    short, mine, theirs = F.substring(on, 1, 4).alias("short"), [c for c in left.columns if c != on], [c for c in right.columns if c != on]
    same = right.groupBy(short).agg(F.collect_list(F.struct(F.col(on).alias("full"), *theirs)).alias("same"))
    joined = left.withColumn("short", short).join(same, "short")
    confirmed = F.filter("same", lambda x: x["full"] == F.col(on))
    return joined.select(*mine, F.explode(confirmed).alias("x")).select(*mine, *[f"x.{c}" for c in theirs])


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")


def classify(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict, one row per row.

    rules: (action, host, path), hosts in lower case; a rule fits its host and all subdomains where the path starts with the rule's; the longest
    host and path wins, then ``block`` before ``allow``.  Without one rule is null and the verdict is ``default``.  A null url, or
    one without ``://``, has empty host and path.  Repeated urls are matched once; repeated rows stay; other columns are ignored;
    an empty table gives an empty one; no rules: all get the default; rules with a null are none.  A very long url is matched whole: one prefix for each
    length of a path in the rules of its host.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = rules.select("action", "host", "path").where("action IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL").distinct()
    keyed = rules.select(_digest(F.col("host"), F.col("path")).alias("digest"), F.concat("host", "path").alias("rule"), "action", F.length(F.concat("host", "path")).alias("reach"))
    lengths = rules.groupBy(_digest(F.col("host")).alias("digest")).agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    distinct = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    hosts = distinct.select("host").distinct().withColumn("suffix", F.explode(suffixes)).withColumn("digest", _digest(F.col("suffix")))
    known = _meet(hosts, lengths, "digest").groupBy("host").agg(F.collect_list(F.struct("suffix", "lengths")).alias("ways"))  # as many as a host has labels
    ways = distinct.join(known, "host").select("host", "path", F.explode("ways").alias("w"))
    prefixes = F.transform(F.filter("w.lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = ways.select("host", "path", "w.suffix", F.explode(prefixes).alias("prefix")).withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
    best = _meet(expressions, keyed, "digest").groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max(F.struct("reach", "action", "rule")).alias("best"))
    found = parsed.join(best, (parsed["host"] == best["h"]) & (parsed["path"] == best["p"]), "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op4_url_filters(spark, sf_dir) -> DataFrame:
    return classify(table(spark, sf_dir, "pages"), rule_table(spark))


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(action, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.action FROM u LEFT JOIN r
  ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(action, length(rule)), 'allow') AS verdict
FROM m GROUP BY page_id, host, path
"""

"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into ``host suffix + path prefix`` expressions; these meet the rules
in an equi-join on a short prefix of their SHA-256, full digests confirm the hits, and the
longest confirmed rule decides.  Distinct (host, path) pairs are expanded, so repeated
URLs cost one expansion; the verdict goes back to the rows by an equi-join.

Only expressions that some rule could equal are made.  Distinct hosts are expanded into
suffixes of as many labels as the longest rule has at most, and meet the rules' hosts; each
match brings the lengths of the paths that occur under that rule host, and a URL's path is
cut to these lengths alone.  The plan is the same for any number of rules, which stay a
DataFrame; the only value that comes to the driver is the largest label count.

Defined results: see ``split_url``; a URL without host matches no rule; without a matching
rule the verdict is ``default``.  Of rules of equal length ``allow`` wins over ``block``;
repeated rules count once.  Native expressions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = 8  # hex digits of the digest that are joined on: 32 bits


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, with A-Z lower-cased; path what follows up to ``?``, ``#`` or the end.  Both
    are empty for null and for a URL without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as ``rule, host, path, verdict``."""
    rows = [(h + p, h, p, v) for h, p, v in rules]
    return spark.createDataFrame(rows, "rule string, host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _labels(host: str) -> Column:
    return F.size(F.split(host, r"\."))


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = rules.dropDuplicates().select("rule", "verdict", _digest(F.col("host"), F.col("path")).alias("full"))
    keyed = keyed.withColumn("short", F.substring("full", 1, PREFIX))
    most = rules.agg(F.max(_labels("host"))).first()[0] or 0

    urls = rows.where(F.col("host") != "").select("host", "path").distinct()
    hosts = urls.select("host").distinct().where(F.lit(most > 0))
    suffixes = hosts.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.least(_labels("host"), F.lit(max(1, most)))),
        lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))).alias("suffix"))
    rule_hosts = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")).select(
        F.sha2("host", 256).alias("r_full"), F.substring(F.sha2("host", 256), 1, PREFIX).alias("short"), "lengths")
    under = (
        suffixes.withColumn("short", F.substring(F.sha2("suffix", 256), 1, PREFIX)).join(rule_hosts, "short")
        .where(F.sha2("suffix", 256) == F.col("r_full"))
        .groupBy("host").agg(F.collect_list(F.struct("suffix", "lengths")).alias("under")))  # at most a row per label
    expressions = F.flatten(F.transform("under", lambda u: F.transform(
        F.filter(u["lengths"], lambda n: n <= F.length("path")), lambda n: _digest(u["suffix"], F.substring(F.col("path"), F.lit(1), n)))))
    expanded = urls.join(under, "host").select("host", "path", F.explode(expressions).alias("full_url"))
    hits = (
        expanded.withColumn("short", F.substring("full_url", 1, PREFIX)).join(keyed, "short")  # candidates
        .where(F.col("full_url") == F.col("full")))  # confirmed
    best = hits.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(
        F.max(F.struct(F.length("rule").alias("chars"), (F.col("verdict") == "allow").alias("allow"), "rule", "verdict")).alias("best"))
    # rows without host match nothing, and would all meet under one key
    judged = rows.where(F.col("host") != "").join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
    return judged.unionByName(rows.where(F.col("host") == "").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))

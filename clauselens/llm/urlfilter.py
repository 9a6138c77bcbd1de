"""Operator 4: URL filters by host-suffix and path-prefix expressions.

Every (host, path) is expanded into the host suffixes that rules can have (the distinct
numbers of labels of the rules' hosts), each joined with the prefixes of its path that
rules can have (the distinct lengths of the rules' paths), so a host of very many labels
yields no more expressions than any other.
Expressions meet the rules in an equi-join on the first 32 bits of their SHA-256;
the full digest confirms a match, and the longest matching rule decides.

URLs are judged once per distinct (host, path) and the verdicts joined back, so
repeated pages cost no more and a host with most pages is spread by its paths. Pages
without a host match nothing; in that join they are spread by their ids.

Edge cases: a null url or one without ``://`` has an empty host and path and matches
nothing; an empty path starts with no rule path but the empty one; of equally long
rules that match the one with the longer host wins; of equal rules with different
verdicts ``block`` wins; without a matching rule the verdict is ``allow`` (the
``default``). A null page_id is kept as null. An empty rule table or page table is
fine. Only the id and url columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query's contract (host, path, verdict).
CONTRACT_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
                  ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def contract_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONTRACT_RULES), "host string, path string, verdict string")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _ints(values: list) -> Column:
    return F.array(*[F.lit(n) for n in values]) if values else F.array().cast("array<int>")


def _labels(host) -> Column:
    return F.split(host, r"\.", -1)


def host_suffixes(host: Column, sizes: list) -> Column:
    """Of the host and the domains above it those with one of the numbers of labels."""
    labels = _labels(host)
    n = F.size(labels)
    return F.transform(F.filter(_ints(sizes), lambda k: n >= k),
                       lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def path_prefixes(path: Column, lengths: list) -> Column:
    """Prefixes of the path that have one of the lengths."""
    cand = _ints(lengths)
    return F.transform(F.filter(cand, lambda n: F.length(path) >= n), lambda n: F.substr(path, F.lit(1), n))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict."""
    spark = prepare(pages.sparkSession)
    rules = (rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
             .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
             .groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).alias("v"))
             .select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), "host", "path",
                     F.col("v.verdict").alias("rule_verdict")))
    rules = rules.withColumn("rule_digest", F.sha2("rule", 256)).withColumn("short", F.substr("rule_digest", F.lit(1), F.lit(8)))
    # As many values as rules differ in length or number of labels; neither is longer than a url.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    sizes = sorted(r[0] for r in rules.select(F.size(_labels("host"))).distinct().collect())
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    expr = (urls.where("host != ''").select("host", "path").distinct()
            .withColumn("prefix", F.explode(path_prefixes(F.col("path"), lengths)))
            .withColumn("suffix", F.explode(host_suffixes(F.col("host"), sizes)))
            .withColumn("digest", F.sha2(F.concat("suffix", "prefix"), 256))
            .select("host", "path", "digest", F.substr("digest", F.lit(1), F.lit(8)).alias("short")))
    hits = (expr.join(rules.drop("host", "path"), "short").where("digest = rule_digest")
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("len"), "host_len", "rule", "rule_verdict")).alias("best")))
    spread = F.when(F.col("host") == "", F.xxhash64("page_id")).otherwise(0)
    return (urls.withColumn("spread", spread).join(hits.withColumn("spread", F.lit(0).cast("long")), ["host", "path", "spread"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")))

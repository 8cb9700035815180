"""URL filtering by an equi-join of expanded expressions with hashed rules.

A rule is a host, a path and a verdict. Each distinct URL is expanded into its
host suffixes (of as many labels as rules have) and its path prefixes (of the
lengths that rules have), and an expression is a suffix followed by a prefix. URLs meet
rules on a short prefix of the expression's SHA-256; the full digest confirms,
and the longest rule that fits wins.

Scale: only distinct URLs are expanded, on the executors and in native
expressions, at a cost that is linear in the URL; a page table of one hot host or
URL does not grow the join. Which
side of the join is broadcast, if any, is left to the planner's size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SHORT = 4  # bytes of the digest that the join uses
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def _digest(text):
    return F.sha2(text, 256)


def _labels(host: str):
    """How many labels a host has: its dots and one."""
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's;
    of the rules that fit, the longest (host and path together) wins, and of
    equal ones a block. A null URL, or one without ``://``, has empty host and
    path, which no rule with a host fits. URLs that no rule fits get ``default``.
    URLs and hosts may be of any length and have any number of labels.
    Null ids and repeated rows pass through; rules with a null host, path or
    verdict are ignored. Either table may be empty; other columns are not read.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    keyed = pages.select(F.col(id_col), url.alias("_u"))
    rest = F.when(F.locate("://", F.col("_u")) > 0, F.expr("substring(_u, locate('://', _u) + 3)")).otherwise("")
    urls = keyed.select("_u").distinct().withColumn("_rest", rest).select(
        "_u", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    known = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat("host", "path").alias("rule"), F.col("path").alias("r_path"), _labels("host").alias("r_labels"), "verdict")
    # As many as rules have path lengths and numbers of labels.
    lengths = sorted(r[0] for r in known.select(F.length("r_path")).distinct().collect())
    depths = sorted(r[0] for r in known.select("r_labels").distinct().collect())
    hashed = known.withColumn("r_full", _digest(F.concat_ws("\n", F.expr("substring(rule, 1, length(rule) - length(r_path))"), "r_path"))).select(
        "rule", "verdict", "r_full", F.substring("r_full", 1, 2 * SHORT).alias("short"))
    deep = F.array(*[F.lit(n) for n in depths]).cast("array<int>")
    suffixes = F.transform(F.filter(deep, lambda n: n <= F.col("_n")), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    prefixes = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    fitting = (
        urls.where("host <> ''").withColumn("_n", _labels("host")).select("_u", F.explode(suffixes).alias("s"), prefixes.alias("ps"))
        .select("_u", "s", F.explode("ps").alias("p")).withColumn("full", _digest(F.concat_ws("\n", "s", "p")))
        .withColumn("short", F.substring("full", 1, 2 * SHORT))
        .join(hashed, "short").where("full = r_full")
    )
    best = fitting.groupBy("_u").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
    judged = urls.join(best, "_u", "left").select(
        "_u", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return keyed.join(judged, "_u").drop("_u")

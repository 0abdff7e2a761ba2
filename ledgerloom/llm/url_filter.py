"""URL filters by host-suffix and path-prefix expressions.

Each distinct (host, path) expands into the host suffixes with as many labels as
some rule's host has, times the path prefixes of a length that some rule has, so
a long host or path makes no more of them.  Expressions meet rules
in an equi-join on the first 32 bits of their SHA-256; the full digest then
confirms the match and the longest rule decides.  Everything is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest that the join uses.
PREFIX = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    start = F.locate("://", url)
    after = F.when(start > 0, F.substr(url, start + F.lit(3))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as rows (host, path, verdict); verdict is ``allow`` or ``block``."""
    names = ("rule_host", "rule_path", "rule_verdict")
    row = lambda r: F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, r)))
    one = spark.range(1).select(F.explode(F.array(*map(row, rules or [(None,) * 3]))).alias("r")).select("r.*")
    return one if rules else one.limit(0)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    A rule fits its host and all subdomains when the URL's path starts with the
    rule's path.  The longest rule (host plus path) wins; of two as long, the
    longer host, then block.  ``default`` is the verdict where no rule fits,
    ``rule`` is then null.  A null URL, or one without ``://``, has empty host
    and path.  Rules with a null part never fit.  Existing columns of the four
    names are replaced.  Repeated URLs are judged once.

    Rules without a host never fit.

    Only the distinct lengths of rule paths and numbers of labels of rule hosts
    come to the driver: at most as many numbers as the longest of either has.
    """
    host, path = split_url(F.col(url_col))
    pages = pages.drop("rule", "verdict")
    cut = pages.withColumns({"host": host, "path": path})
    rules = (
        rules.where("rule_host <> '' and rule_path is not null and rule_verdict is not null")
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", F.sha2("rule", 256))
        .groupBy("rule", "digest", "rule_host")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("short", F.substring("digest", 1, PREFIX))
    )
    shapes = rules.select((F.length("rule") - F.length("rule_host")).alias("n"), F.size(F.split("rule_host", r"\.")).alias("labels"))
    found = shapes.agg(F.collect_set("n").alias("n"), F.collect_set("labels").alias("labels")).first()
    lengths, labels = sorted(found["n"]), sorted(found["labels"])
    if not lengths:
        return cut.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    suffixes = F.array_compact(F.array(*(F.when(dots >= n - 1, F.substring_index("host", ".", -n)) for n in labels)))
    prefixes = F.array_compact(
        F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths))
    )
    # A URL without a host meets no rule, however many there are.
    urls = cut.where("host <> ''").select("host", "path").distinct()
    sent = (
        urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("full", F.sha2(F.concat("suffix", "prefix"), 256))
        .withColumn("short", F.substring("full", 1, PREFIX))
    )
    hits = sent.join(rules, "short").where((F.col("full") == F.col("digest")) & (F.col("suffix") == F.col("rule_host")))
    rank = F.struct(F.length("rule"), F.length("rule_host"), F.col("rule_verdict"))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(rank.alias("rank"), F.col("rule"), F.col("rule_verdict").alias("verdict"))).alias("best")
    )
    judged = (
        cut.where("host <> ''").join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))})
        .drop("best")
    )
    free = cut.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return judged.select(*cut.columns, "rule", "verdict").unionAll(free)

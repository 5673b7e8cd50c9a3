"""URL rules looked up by hashes of host-suffix and path-prefix expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pawl.llm.common import quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hex digits of the digest on which rules and expressions are joined before full digests decide.
PREFIX_DIGITS = 8


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    raw = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(raw) + F.lit(1), F.length(after)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """The verdict of the longest rule that fits each URL, else the default.

    A rule fits its host and all subdomains if the path starts with the rule's path. Each distinct
    (host, path) is expanded into the host suffixes that have as many labels as some rule and the
    path prefixes that are as long as some rule's path; these lengths are the only thing taken from
    the rules to the driver and are bounded by the longest rule, not by their number. Expressions
    meet rules by the first PREFIX_DIGITS hex digits of SHA-256; the full digest then decides.
    The longest is the rule with most characters of host and path, then of host; among equal rules
    block goes before allow.

    A null or malformed URL has an empty host and path and gets the default unless a rule has an
    empty host. Rules with a null host or path fit nothing. Repeated pages each get a row. Other
    columns are ignored. Returns page_id, host, path, rule, verdict.
    """
    host, path = parts(quoted(url_col).cast("string"))
    parsed = pages.select(quoted(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    given = rules.where("host IS NOT NULL AND path IS NOT NULL").select(
        "verdict", F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")
    )
    shape = given.select(
        F.sort_array(F.collect_set(F.size(F.split("rule_host", "\\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()
    pick = Window.partitionBy("full").orderBy(F.desc("verdict"))
    keyed = (
        given.withColumn("full", digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("nth", F.row_number().over(pick))
        .where("nth = 1")
        .select(F.substring("full", 1, PREFIX_DIGITS).alias("short"), F.col("full").alias("rule_full"), "verdict", "rule_host", "rule_path")
    )
    labels = F.array(*[F.lit(n) for n in shape["labels"]]).cast("array<int>")
    lengths = F.array(*[F.lit(n) for n in shape["lengths"]]).cast("array<int>")
    expressions = (
        parsed.select("host", "path")
        .distinct()
        .withColumn("pieces", F.split("host", "\\."))
        .withColumn("n", F.explode(F.filter(labels, lambda n: n <= F.size("pieces"))))
        .withColumn("suffix", F.array_join(F.slice("pieces", F.size("pieces") - F.col("n") + F.lit(1), F.col("n")), "."))
        .withColumn("length", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
        .withColumn("full", digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("length"))))
        .select("host", "path", F.substring("full", 1, PREFIX_DIGITS).alias("short"), "full")
    )
    size = F.length("rule_host") + F.length("rule_path")
    best = (
        expressions.join(keyed, "short")
        .where(F.col("full") == F.col("rule_full"))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(size.alias("size"), F.length("rule_host").alias("host_size"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
            ).alias("best")
        )
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )

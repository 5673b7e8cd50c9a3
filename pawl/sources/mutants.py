"""Mutation-test reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = ["total", "caught", "missed", "timeout", "unviable"]
EXAMPLES = 20

SCHEMA = (
    "total_mutants bigint, caught bigint, missed bigint, timeout bigint, unviable bigint, "
    "outcomes array<struct<summary: string, scenario: string>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row of counts and the first 20 names that were missed, in the file's order.

    The five counts must be there and not be negative, and outcomes must be a list; other fields are
    ignored. The report is one JSON object, a few megabytes at most.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("r"))
    counts = [F.col("r.total_mutants"), *[F.col(f"r.{c}") for c in COUNTS[1:]]]
    fine = F.col("r.outcomes").isNotNull()
    for c in counts:
        fine = fine & c.isNotNull() & (c >= 0)
    checked = F.when(F.coalesce(fine, F.lit(False)), counts[0]).otherwise(F.raise_error(F.lit("the mutation report lacks a count or has a negative one")).cast("long"))
    missed = F.filter("r.outcomes", lambda o: o["summary"] == "MissedMutant")
    names = F.filter(F.transform(missed, lambda o: F.get_json_object(o["scenario"], "$.Mutant.name")), lambda n: n.isNotNull())
    return parsed.select(checked.alias("total"), *[c.alias(n) for c, n in zip(counts[1:], COUNTS[1:], strict=True)], F.slice(names, 1, EXAMPLES).alias("missed_examples"))


def summarised(outcomes: DataFrame) -> DataFrame:
    """Counts of outcome rows (summary: caught, missed, timeout or unviable)."""
    return outcomes.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("summary") == c).alias(c) for c in COUNTS[1:]])

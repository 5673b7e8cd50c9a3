"""Measurements as long fixed-point observations, and digests of sets of texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawl.functions.columns import function_key, scaled


def to_long(wide: DataFrame, key: str, scales: Mapping[str, int]) -> DataFrame:
    """A row (id, metric, <key>, value, scale) for each metric column, in one pass; nulls stay null."""
    doubles = wide.select(key, *[F.col(c).cast("double").alias(c) for c in scales])
    names = F.create_map(*[x for c, s in scales.items() for x in (F.lit(c), F.lit(s).cast("long"))])
    rows = doubles.unpivot(key, list(scales), "metric", "raw").withColumn("scale", names[F.col("metric")])
    return rows.select(F.concat("metric", F.lit("@"), F.col(key)).alias("id"), "metric", key, scaled(F.col("raw"), F.col("scale")).alias("value"), "scale")


def sorted_digest(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """SHA-256 of a group's texts, sorted and joined by line feeds. A group is one item's attributes."""
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("digest"))


def error_types(defined: DataFrame, implemented: DataFrame, returned: DataFrame) -> DataFrame:
    """(item, missing): types that functions return as errors, 1 without an Error implementation.

    defined: root, file, name. implemented, returned: root, name. Types meet by bare name within a
    root; of overlapping roots an implementation found anywhere counts.
    """
    used = defined.distinct().join(returned.select("root", "name").distinct(), ["root", "name"], "left_semi")
    marked = used.join(implemented.select("root", "name").distinct().withColumn("has", F.lit(True)), ["root", "name"], "left")
    return marked.groupBy(function_key(F.col("file"), F.col("name")).alias("item")).agg(F.min(F.when(F.col("has"), 0).otherwise(1)).alias("missing"))


def halstead_counts(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct operators n1, distinct operands n2 and all operands, exactly. tokens: tok, operand."""
    per_token = tokens.groupBy(*keys, "tok", "operand").agg(F.count(F.lit(1)).alias("n"))
    return per_token.groupBy(*keys).agg(
        F.count_if(~F.col("operand")).alias("n1"), F.count_if(F.col("operand")).alias("n2"), F.coalesce(F.sum(F.when(F.col("operand"), F.col("n"))), F.lit(0)).cast("long").alias("total_n2")
    )


def halstead_of(tokens: Column, is_operand) -> list[Column]:
    """n1, n2 and total_n2 of an array of tokens, within its row."""
    operands = F.filter(tokens, is_operand)
    operators = F.filter(tokens, lambda t: ~is_operand(t))
    size = lambda x: F.size(x).cast("long")
    return [size(F.array_distinct(operators)).alias("n1"), size(F.array_distinct(operands)).alias("n2"), size(operands).alias("total_n2")]


def halstead_difficulty(counts: DataFrame) -> DataFrame:
    """Adds difficulty (n1 / 2)(N2 / n2), 0 without operands."""
    value = F.when(F.col("n2") > 0, F.col("n1") / 2.0 * (F.col("total_n2") / F.col("n2"))).otherwise(0.0)
    return counts.withColumn("difficulty", value)


def invalid(observations: DataFrame, entities: DataFrame) -> DataFrame:
    """Observations that break an invariant: id, scale, direction or entity."""
    known = entities.select("entity").distinct().withColumn("known", F.lit(True))
    bad = (
        (F.col("id") != F.concat("metric", F.lit("@"), "item"))
        | ~F.col("scale").isin(1, 10, 100)
        | ~F.col("direction").isin("lower", "higher")
        | F.col("known").isNull()
    )
    return observations.join(known, "entity", "left").where(bad).drop("known")

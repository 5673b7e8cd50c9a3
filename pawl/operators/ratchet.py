"""Measurements against targets and a baseline that may only shrink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawl.functions.columns import tenths

KEYS = ["metric", "key"]


def below(value: Column, ceiling: Column, scale: Column) -> Column:
    """True if a ceiling is looser than it need be; floats (scale 10) have a tenth of slack."""
    return F.when(scale == 10, tenths(value) + 1 < tenths(ceiling)).otherwise(value < ceiling)


def duplicate_max(items: DataFrame) -> DataFrame:
    """The largest value of each (metric, key)."""
    return items.groupBy(*KEYS).agg(F.max("value").alias("value"))


def item_status(items: DataFrame, targets: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each item row: within, grandfathered, exceeds (its ceiling) or new (no ceiling, over target).

    items: metric, key, value, ord. targets: metric, target, scale. baseline: metric, key, ceiling.
    """
    over = F.col("value") > F.col("target")
    status = (
        F.when(~over, "within")
        .when(F.col("ceiling").isNull(), "new")
        .when(F.col("value") <= F.col("ceiling"), "grandfathered")
        .otherwise("exceeds")
    )
    return items.join(targets, "metric").join(baseline, KEYS, "left").withColumn("status", status)


def baseline_status(items: DataFrame, targets: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each baseline entry: unmatched, met, loose or pinned, by the largest value of its key."""
    status = (
        F.when(F.col("value").isNull(), "unmatched")
        .when(F.col("value") <= F.col("target"), "met")
        .when(below(F.col("value"), F.col("ceiling"), F.col("scale")), "loose")
        .otherwise("pinned")
    )
    return baseline.join(targets, "metric").join(duplicate_max(items), KEYS, "left").withColumn("status", status)


def violations(items: DataFrame, targets: DataFrame, baseline: DataFrame) -> DataFrame:
    """The rows that fail the gate: metric, key, kind, value, target, ceiling."""
    columns = [*KEYS, F.col("status").alias("kind"), "value", "target", "ceiling"]
    bad = item_status(items, targets, baseline).where(F.col("status").isin("new", "exceeds")).select(*columns)
    stale = baseline_status(items, targets, baseline).where("status <> 'pinned'").select(*columns)
    return bad.unionByName(stale)


def worst(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each metric: the largest value, the first item that has it, and the rows over target."""
    top = F.max(F.struct("value", (-F.col("ord")).alias("o"), "key"))
    return (
        items.join(targets, "metric")
        .groupBy("metric")
        .agg(top.alias("top"), F.count_if(F.col("value") > F.col("target")).alias("over_target"), F.first("target").alias("target"))
        .select("metric", F.col("top.key").alias("worst_key"), F.col("top.value").alias("worst_value"), "over_target", "target")
    )


def report_rows(items: DataFrame, targets: DataFrame, baseline: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """A row for each metric of targets: worst, over_target, meets_target, passes_gate, measured.

    A metric outside `measured` (one column metric; all by default) has no figures and passes, and
    its baseline entries are not held against it.
    """
    seen = targets.select("metric") if measured is None else measured.select("metric").distinct()
    own = targets.join(seen, "metric", "left_semi")
    failing = violations(items, own, baseline).groupBy("metric").agg(F.count(F.lit(1)).alias("n_violations"))
    rows = worst(items, own).drop("target")
    return (
        targets.join(seen.withColumn("measured", F.lit(True)), "metric", "left")
        .join(rows, "metric", "left")
        .join(failing, "metric", "left")
        .select(
            "metric",
            "target",
            F.coalesce("measured", F.lit(False)).alias("measured"),
            "worst_key",
            "worst_value",
            F.coalesce("over_target", F.lit(0)).cast("long").alias("over_target"),
            F.when(F.col("measured").isNotNull(), F.coalesce("over_target", F.lit(0)) == 0).otherwise(False).alias("meets_target"),
            (F.coalesce("n_violations", F.lit(0)) == 0).alias("passes_gate"),
        )
    )


def gate_passed(rows: DataFrame) -> DataFrame:
    """One row: whether every row passes."""
    return rows.agg(F.coalesce(F.bool_and("passes_gate"), F.lit(True)).alias("passed"))


SLACK_POINTS = 1.0


def coverage_rule(measured: DataFrame) -> DataFrame:
    """Floor rules for rows of percent, target, floor (null: the target is the floor).

    `status` is unmeasured, ok, below_floor, met (a floor that is not needed any more) or loose;
    below_floor and met cannot hold together, as a floor is at most the target.
    """
    floor = F.coalesce("floor", "target")
    status = (
        F.when(F.col("percent").isNull(), "unmeasured")
        .when(F.col("percent") < floor, "below_floor")
        .when(F.col("floor").isNotNull() & (F.col("percent") >= F.col("target")), "met")
        .when(F.col("percent") - F.col("floor") > SLACK_POINTS + 1e-9, "loose")
        .otherwise("ok")
    )
    return measured.withColumn("enforced", floor).withColumn("status", status).withColumn("passes_gate", F.col("status").isin("ok", "unmeasured"))


def mutants_rule(mutants: DataFrame, most: int = 0) -> DataFrame:
    """The gate on surviving mutants: missed beyond the limit fail, timeouts never do."""
    return mutants.withColumn("passes_gate", F.col("missed") <= most)

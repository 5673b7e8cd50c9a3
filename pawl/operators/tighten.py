"""Shrinking a baseline to what is measured now, and making a fresh one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pawl.functions.columns import coverage_floor, float_ceiling
from pawl.operators.ratchet import duplicate_max


def clamp(old: DataFrame, fresh: DataFrame, measured: DataFrame | None = None, keys: Sequence[str] = ("metric", "key")) -> DataFrame:
    """Every key of old or fresh with its outcome and the ceiling that stays (null: none).

    Outcomes: removed (not in fresh), lowered, kept, raise_refused (fresh is higher), refused (only
    in fresh), untouched (a metric outside `measured`). The result of tightening is the rows whose
    ceiling is not null. Deeper keys, such as (metric, group, key), work alike.
    """
    keys = list(keys)
    o, n = F.col("old_ceiling"), F.col("fresh_ceiling")
    both = old.select(*keys, F.col("ceiling").alias("old_ceiling")).join(fresh.select(*keys, F.col("ceiling").alias("fresh_ceiling")), keys, "full")
    if measured is None:
        both = both.withColumn("known", F.lit(True))
    else:
        both = both.join(measured.select("metric").distinct().withColumn("known", F.lit(True)), "metric", "left")
    outcome = (
        F.when(F.col("known").isNull() & o.isNotNull(), "untouched")
        .when(F.col("known").isNull(), "ignored")
        .when(o.isNull(), "refused")
        .when(n.isNull(), "removed")
        .when(n < o, "lowered")
        .when(n > o, "raise_refused")
        .otherwise("kept")
    )
    ceiling = F.when(F.col("outcome") == "lowered", n).when(~F.col("outcome").isin("removed", "refused", "ignored"), o)
    return both.withColumn("outcome", outcome).withColumn("ceiling", ceiling).where("outcome <> 'ignored'").drop("known")


def clamp_floor(floors: DataFrame) -> DataFrame:
    """Coverage floors (old_floor, fresh_floor), which may only rise."""
    o, n = F.col("old_floor"), F.col("fresh_floor")
    outcome = (
        F.when(o.isNotNull() & n.isNull(), "removed")
        .when(o.isNotNull() & (n > o), "lowered")
        .when(o.isNull() & n.isNotNull(), "refused")
        .otherwise("kept")
    )
    floor = F.when(F.col("outcome") == "lowered", n).when(F.col("outcome") == "kept", o)
    return floors.withColumn("outcome", outcome).withColumn("floor", floor)


def summary(clamped: DataFrame) -> DataFrame:
    """One row: entries removed, lowered and refused."""
    return clamped.agg(
        F.count_if(F.col("outcome") == "removed").alias("removed"),
        F.count_if(F.col("outcome") == "lowered").alias("lowered"),
        F.count_if(F.col("outcome").isin("refused", "raise_refused")).alias("refused"),
    )


def needs_tightening(clamped: DataFrame) -> DataFrame:
    """One row: whether tightening would remove or lower anything."""
    return clamped.agg(F.coalesce(F.bool_or(F.col("outcome").isin("removed", "lowered")), F.lit(False)).alias("needed"))


def fresh_baseline(items: DataFrame, targets: DataFrame) -> DataFrame:
    """A ceiling for the largest value of every key that is over its target: (metric, key, ceiling)."""
    over = duplicate_max(items).join(targets, "metric").where("value > target")
    return over.select("metric", "key", F.when(F.col("scale") == 10, float_ceiling(F.col("value"))).otherwise(F.col("value")).alias("ceiling"))


def fresh_floor(measured: DataFrame) -> DataFrame:
    """A floor for coverage (percent, target) that misses its target, else null."""
    return measured.withColumn("floor", F.when(F.col("percent") < F.col("target"), coverage_floor(F.col("percent"))))

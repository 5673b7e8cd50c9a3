"""Two snapshots: what improved, what regressed, what cannot be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pawl.functions.columns import excess

CONTRACT = ["metric", "entity", "target", "scale", "direction"]


def is_lint(metric):
    return metric.isin("dead_code", "redundant_code") | F.startswith(metric, F.lit("lints."))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every observation of either side with its outcome.

    Columns: id, outcome (improved, regressed, unchanged, ignored, contract_changed, disappeared,
    availability_changed), before, after, target, scale, excess_before, excess_after. A lint that is
    absent counts 0; an observation that is new counts its target before.
    """
    side = lambda df, mark: df.select("id", *[F.col(c).alias(f"{mark}_{c}") for c in [*CONTRACT, "value"]], F.lit(True).alias(f"{mark}_here"))
    both = side(before, "b").join(side(after, "a"), "id", "full")
    pick = {c: F.coalesce(f"b_{c}", f"a_{c}") for c in CONTRACT}
    in_both = F.col("b_here") & F.col("a_here")
    same = F.lit(True)
    for c in CONTRACT:
        same = same & F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    lint = is_lint(pick["metric"])
    unmeasured = (F.col("b_here") & F.col("b_value").isNull()) | (F.col("a_here") & F.col("a_value").isNull())
    old = F.coalesce("b_value", F.when(lint, F.lit(0).cast("long")).otherwise(pick["target"]))
    new = F.coalesce("a_value", F.lit(0).cast("long"))
    found = both.select(
        "id",
        pick["target"].alias("target"),
        pick["scale"].alias("scale"),
        old.alias("before"),
        new.alias("after"),
        excess(old, pick["target"], pick["direction"]).alias("excess_before"),
        excess(new, pick["target"], pick["direction"]).alias("excess_after"),
        F.when(in_both & ~same, "contract_changed")
        .when(F.col("a_here").isNull() & ~lint, "disappeared")
        .when(in_both & (F.col("b_value").isNull() != F.col("a_value").isNull()), "availability_changed")
        .when(F.coalesce(unmeasured, F.lit(False)), "ignored")
        .alias("early"),
    )
    late = F.when(F.col("excess_after") < F.col("excess_before"), "improved").when(F.col("excess_after") > F.col("excess_before"), "regressed").otherwise("unchanged")
    return found.withColumn("outcome", F.coalesce("early", late)).drop("early")


def item_reasons(changes: DataFrame) -> DataFrame:
    """Reasons (ord, reason) why observations cannot be compared, in order of their ids."""
    text = (
        F.when(F.col("outcome") == "contract_changed", F.concat(F.lit("the contract of an observation differs: "), "id"))
        .when(F.col("outcome") == "disappeared", F.concat(F.lit("no measurement any more: "), "id"))
        .when(F.col("outcome") == "availability_changed", F.concat(F.lit("measured on one side only: "), "id"))
    )
    return changes.select(text.alias("reason")).where("reason IS NOT NULL")


def changed_tests(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids of test contracts (id, hash) that are gone or differ."""
    other = after.select("id", F.col("hash").alias("now"))
    return before.join(other, "id", "left").where(~F.col("hash").eqNullSafe(F.col("now"))).select("id")


def changed_gates(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids of compilation gates that differ; a gate that is gone is fine if it was empty."""
    other = after.select("id", F.col("hash").alias("now"))
    now = F.coalesce("now", F.sha2(F.lit("").cast("binary"), 256))
    return before.join(other, "id", "left").where(~F.col("hash").eqNullSafe(now)).select("id")


def removed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of before that after lacks: entities, inputs."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


REQUIRED = ["source", "clippy", "tests"]


def failed_checks(checks: DataFrame, doctests: bool = False, coverage: bool = False) -> DataFrame:
    """Required checks (name, status) without the status that they need."""
    needed = [(c, "passed") for c in REQUIRED] + [("doctests", "passed" if doctests else "not_applicable")] + ([("coverage", "passed")] if coverage else [])
    wanted = checks.sparkSession.createDataFrame(needed, "name string, needed string")
    return wanted.join(checks, "name", "left").where(~F.col("status").eqNullSafe(F.col("needed"))).select("name", "needed", "status")


def context_reasons(before: DataFrame, after: DataFrame, what: str) -> DataFrame:
    """A reason if two one-row tables (contexts, policies) differ in any column."""
    columns = sorted(before.columns)
    a = before.select(F.struct(*columns).alias("a"))
    b = after.select(F.struct(*columns).alias("b"))
    # one row each, by their contract
    return a.join(b, F.lit(True)).where(~F.col("a").eqNullSafe(F.col("b"))).select(F.lit(f"{what} differs").alias("reason"))


def decision(changes: DataFrame, reasons: DataFrame, needs_tightening: bool = False) -> DataFrame:
    """One row: measurement, quality_change, eligible_to_tighten, baseline_action, reasons.

    Any reason makes the snapshots incomparable; else a regression decides, then an improvement.
    Compatibility reasons come sorted and once, reasons of observations follow in id order.
    """
    counts = changes.agg(
        F.count_if(F.col("outcome") == "improved").alias("improved"),
        F.count_if(F.col("outcome") == "regressed").alias("regressed"),
        F.count_if(F.col("outcome").isin("contract_changed", "disappeared", "availability_changed")).alias("items"),
    )
    compat = reasons.select("reason").distinct().agg(F.array_sort(F.collect_list("reason")).alias("compat"))
    listed = item_reasons(changes).agg(F.array_sort(F.collect_list("reason")).alias("listed"))
    change = (
        F.when((F.col("items") > 0) | (F.size("compat") > 0), "incomparable")
        .when(F.col("regressed") > 0, "regressed")
        .when(F.col("improved") > 0, "improved")
        .otherwise("unchanged")
    )
    return (
        counts.join(compat, F.lit(True))
        .join(listed, F.lit(True))
        .withColumn("quality_change", change)
        .select(
            F.when(F.col("quality_change") == "incomparable", "incomparable").otherwise("complete").alias("measurement"),
            "quality_change",
            (F.col("quality_change") == "improved").alias("eligible_to_tighten"),
            F.when((F.col("quality_change") == "improved") & F.lit(needs_tightening), "tighten_required").otherwise("none").alias("baseline_action"),
            F.concat("compat", "listed").alias("reasons"),
            "improved",
            "regressed",
        )
    )

"""What to do about a violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pawl.functions.columns import hint_key

HINTS = {
    "cyclomatic": "Split the function at its decisions, or turn branches into data.",
    "cognitive": "Return early and pull nested blocks into functions with names.",
    "halstead": "Name partial results and use fewer kinds of operators in one place.",
    "file_loc": "Move a group of related items to a module of its own.",
    "unsafe": "Use a safe equivalent, or wrap the block once behind a checked function.",
    "panic": "Give the failure back to the caller as a Result.",
    "bare_panic": "Say in the message why the failure cannot happen.",
    "allow": "Fix what the lint says, or write an expectation with its reason.",
    "bare_allow": "Turn the suppression into an expectation that states a reason.",
    "pub_wrapper": "Take the value itself, not the smart pointer around it.",
    "get_prefix": "Name the accessor after the field.",
    "file_allow": "Narrow the suppression to the item that needs it.",
    "file_bare_allow": "State a reason, or narrow the suppression.",
    "deny_warnings": "Name the lints to deny, so that a new compiler does not break the build.",
    "missing_error_impl": "Implement the standard error trait for the type.",
    "coverage": "Test the lines that no test reaches.",
    "crap": "Test the function, or make it simpler; either lowers the score.",
    "mutants": "Write the assertion that the surviving change gets past.",
    "dead code": "Remove what nothing uses.",
    "redundant code": "Apply the simpler form that the lint shows.",
    "lints": "Fix the finding, or change the group's limit on purpose.",
    "baseline": "The baseline allows more than is needed: tighten it.",
}


def dictionary(spark) -> DataFrame:
    return spark.createDataFrame(list(HINTS.items()), "metric string, hint string")


def for_violations(violations: DataFrame) -> DataFrame:
    """Each hint that applies, once, with the place of its first violation. violations: ord, text."""
    keyed = violations.select(hint_key(F.col("text")).alias("metric"), "ord")
    first = keyed.groupBy("metric").agg(F.min("ord").alias("first_ord"))
    return first.join(dictionary(violations.sparkSession), "metric").select("metric", "first_ord", "hint")

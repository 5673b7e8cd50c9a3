"""Line coverage of files and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HITS = (1 << 63) - 1


def line_hits(records: DataFrame) -> DataFrame:
    """Records of one line add up; sums beyond a long stay at its largest value."""
    total = F.least(F.sum(F.col("hits").cast("decimal(20,0)")), F.lit(MAX_HITS).cast("decimal(20,0)"))
    return records.groupBy("file", "line").agg(total.cast("long").alias("hits"))


def totals(lines: DataFrame) -> DataFrame:
    """One row: instrumented and covered lines and the percentage, 0 without lines."""
    found = lines.agg(F.count(F.lit(1)).alias("instrumented"), F.count_if(F.col("hits") > 0).alias("covered"))
    percent = F.when(F.col("instrumented") > 0, F.col("covered") / F.col("instrumented") * 100).otherwise(0.0)
    return found.withColumn("percent", percent)


def within(lines: DataFrame, functions: DataFrame):
    """The condition of a range join: same file, line inside the span, ends included."""
    return (lines["file"] == functions["file"]) & lines["line"].between(functions["start_line"], functions["end_line"])


def production_lines(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """Lines inside a function, each once however many spans hold it."""
    return lines.join(functions, within(lines, functions), "left_semi")


def crap_scores(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """CRAP of each function with instrumented lines: cc^2 (1 - coverage)^3 + cc.

    functions: file, name, ord, start_line, end_line, cyclomatic. The lines of a file are joined to
    its functions by the equal file and counted before anything else, so no pair outlives the join.
    """
    spans = functions.select("ord", F.col("file").alias("f_file"), "name", "start_line", "end_line", "cyclomatic")
    inside = (F.col("file") == F.col("f_file")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    counted = (
        spans.join(lines, inside)
        .groupBy("f_file", "name", "ord", "cyclomatic")
        .agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("hits") > 0).alias("covered"))
    )
    cover, cc = F.col("covered") / F.col("lines"), F.col("cyclomatic").cast("double")
    return counted.select(
        F.col("f_file").alias("file"), "name", "ord", "cyclomatic", (cover * 100).alias("coverage_pct"), (cc * cc * F.pow(1.0 - cover, F.lit(3.0)) + cc).alias("crap")
    )


def crap_order(scores: DataFrame) -> list:
    """The report's order: worst first, equals in the order of the functions."""
    return [F.desc("crap"), F.col("ord")]

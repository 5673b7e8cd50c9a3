"""Compiler messages as JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pawl.functions.columns import repo_relative

SPAN = "array<struct<file_name: string, line_start: bigint, column_start: bigint, is_primary: boolean>>"
SCHEMA = (
    "reason string, package_id string, fresh boolean, success boolean, "
    f"message struct<level: string, message: string, code: struct<code: string>, spans: {SPAN}>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Log lines (ord, line, v), in the order of files, blocks and lines."""
    place = F.col("_metadata")
    order = F.struct(place["file_path"], place["file_block_start"], F.monotonically_increasing_id())
    return parsed(spark.read.text(path).select(order.alias("ord"), F.col("value").alias("line")))


def parsed(lines: DataFrame) -> DataFrame:
    """Adds v, the fields of a line's JSON, null for lines that are none. lines: ord, line.

    The condition on the row's number always holds. It keeps filters on v above, which would otherwise be
    moved below with a copy of the parse for each field that they read.
    """
    good = F.expr("try_parse_json(line)").isNotNull()
    return lines.select("ord", "line", F.when((F.monotonically_increasing_id() >= 0) & good, F.from_json("line", SCHEMA)).alias("v"))


def rebuilt_local() -> Column:
    """A package of the workspace that was compiled in this run."""
    return F.coalesce((F.col("v.reason") == "compiler-artifact") & F.col("v.package_id").contains("path+file://") & ~F.col("v.fresh"), F.lit(False))


def stale(log: DataFrame) -> DataFrame:
    """One row: whether the log has neither a message nor a package that was compiled."""
    message = F.coalesce(F.col("v.reason") == "compiler-message", F.lit(False))
    return log.agg((~F.coalesce(F.bool_or(message | rebuilt_local()), F.lit(False))).alias("stale"))


def findings(log: DataFrame, root: str = "") -> DataFrame:
    """(code, file, line, column, message) of each message with a code, located by its first primary span."""
    span = F.get(F.filter("v.message.spans", lambda s: s["is_primary"]), F.lit(0))
    zero = F.lit(0).cast("long")
    natural = lambda c: F.when(c >= 0, c).otherwise(zero)
    return log.where("v.reason = 'compiler-message' AND v.message.code.code IS NOT NULL").select(
        F.col("v.message.code.code").alias("code"),
        F.coalesce(repo_relative(span["file_name"], root), F.lit("<unknown>")).alias("file"),
        F.coalesce(natural(span["line_start"]), zero).alias("line"),
        F.coalesce(natural(span["column_start"]), zero).alias("column"),
        F.coalesce("v.message.message", F.lit("")).alias("message"),
    )


def checked_findings(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """Deduplicated findings; a stale log is an error, as it would hide findings."""
    log = read(spark, path)
    if log.where(F.trim("line") != "").isEmpty() or stale(log).first()["stale"]:
        raise ValueError("the lint log has no messages and nothing was compiled: lint again from a clean state")
    return findings(log, root).dropDuplicates()


NAME_LINTS = ["renamed_and_removed_lints", "unknown_lints"]


def faults(log: DataFrame, members: Sequence[str]) -> DataFrame:
    """(fault, detail) of everything that a strict reader refuses; no rows for a sound log."""
    rows = log.where(F.trim("line") != "")
    bad = rows.select(
        F.when(F.col("v").isNull(), "malformed")
        .when(F.col("v.message.level") == "error", "error")
        .when(F.col("v.message.code.code").isin(NAME_LINTS), "unknown lint")
        .when((F.col("v.reason") == "build-finished") & ~F.coalesce("v.success", F.lit(False)), "unsuccessful build")
        .alias("fault"),
        F.col("line").alias("detail"),
    ).where("fault IS NOT NULL")
    local = F.when(rebuilt_local() & F.col("v.package_id").isin(list(members)), F.col("v.package_id"))
    ends = rows.agg(F.max(F.when(F.col("v.reason") == "build-finished", F.col("ord"))).alias("done"), F.max("ord").alias("last"), F.collect_set(local).alias("built"))
    note = lambda fault, detail: F.struct(F.lit(fault).alias("fault"), detail.alias("detail"))
    after = F.filter(F.array(note("not finished", F.lit(""))), lambda _: F.expr("done IS NULL OR last > done"))
    wanted = F.array(*[F.lit(m) for m in members]).cast("array<string>")
    missing = F.transform(F.filter(wanted, lambda m: ~F.array_contains("built", m)), lambda m: note("not rebuilt", m))
    return bad.union(ends.select(F.inline(F.concat(after, missing))))


def member_lines(log: DataFrame, members: Sequence[str]) -> DataFrame:
    """The records of the workspace's own packages."""
    return log.where(F.col("v.package_id").isin(list(members)))


def lint_inventory(help_lines: DataFrame) -> DataFrame:
    """Lint names (one column code) in a compiler's list of lints: the second word is a level."""
    words = F.split(F.trim("value"), "\\s+")
    level = F.get(words, F.lit(1)).isin("allow", "warn", "deny", "forbid")
    return help_lines.where(level).select(F.translate(words[0], "-", "_").alias("code")).distinct()

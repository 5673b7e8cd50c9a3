"""The given tables in the roles of measurements, coverage, findings and snapshots.

They are analogues for trying the operators' semantics, not workloads of a code base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPLIT = "1998-01-01"


def part_counts(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """Items (metric, key, value, ord): line items of each part since SPLIT, or before it."""
    period = F.col("l_shipdate") >= F.lit(SPLIT).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "lineitem").where(period if late else ~period)
    counted = rows.groupBy(F.col("l_partkey").alias("ord")).agg(F.count(F.lit(1)).alias("value"))
    return counted.select(F.lit("cyclomatic").alias("metric"), F.concat(F.lit("src/part.rs::p"), F.col("ord").cast("string")).alias("key"), "value", "ord")


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later counts of all parts; every seventh has moved to another file, so that some baseline entries match nothing."""
    moved = F.when(F.col("ord") % 7 == 0, F.concat(F.lit("src/moved.rs::p"), F.col("ord").cast("string"))).otherwise(F.col("key"))
    return part_counts(spark, sf_dir, True).withColumn("key", moved)


def part_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_counts(spark, sf_dir, False).where("value > 12").select("metric", "key", F.col("value").alias("ceiling"))


def part_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("cyclomatic", 17, 1)], "metric string, target long, scale long")


def supplier_floats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, targets and baseline of a float metric: mean quantity of each supplier, in hundredths."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    mean = F.expr("s * 100 div n") / 100.0
    items = rows.select(F.lit("halstead").alias("metric"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("key"), mean.alias("value"), F.col("l_suppkey").alias("ord"))
    baseline = rows.select(F.lit("halstead").alias("metric"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("key"), (mean + F.expr("l_suppkey % 4") / 10.0).alias("ceiling"))
    targets = spark.createDataFrame([("halstead", 25.0, 10)], "metric string, target double, scale long")
    return items, targets, baseline


def coverage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, hits): an order is a file; a line item is a record, hit if its quantity is over 25."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), F.col("l_linenumber").cast("long").alias("line"), (F.col("l_quantity") > 25).cast("long").alias("hits")
    )


def order_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three functions in each order's file, two of them nested; complexity from the priority."""
    spans = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(a).cast("long").alias("start_line"), F.lit(b).cast("long").alias("end_line"), F.lit(k).cast("long").alias("nth")) for k, (n, a, b) in enumerate([("head", 1, 3), ("tail", 4, 7), ("inner", 2, 2)])]
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("cyclomatic"), F.explode(spans).alias("x"))
    return rows.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("file"), "x.name", (F.col("o_orderkey") * 3 + F.col("x.nth")).alias("ord"), "x.start_line", "x.end_line", "cyclomatic")


CODES = {"click": "dead_code", "view": "clippy::needless_return", "purchase": "clippy::unwrap_used", "signup": "unused_mut", "logout": "clippy::too_many_lines"}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: the type is a code, the user a file, the day of the month a line."""
    code = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in CODES.items()], F.concat(F.lit("clippy::x_"), F.col("event_type")))
    return table(spark, sf_dir, "events").select(
        code.alias("code"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.dayofmonth("ts").cast("long").alias("line"), F.lit(1).cast("long").alias("column"), F.lit("m").alias("message")
    )


def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans over days, among them two of equal width around day 8, where the first one wins."""
    spans = [("a", 1, 10), ("b", 6, 10), ("c", 5, 9), ("d", 15, 20)]
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).cast("long").alias("start_line"), F.lit(e).cast("long").alias("end_line"), F.lit(k).cast("long").alias("ord")) for k, (n, s, e) in enumerate(spans)])
    return users.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.explode(each).alias("x")).select("file", "x.*")


GROUPS = [("size", "clippy::too_*"), ("unwraps", "clippy::unwrap_used"), ("wide", "clippy::t*")]


def lint_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUPS, "grp string, pattern string")


def snapshot_side(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Observations of one year: line items of each part as a function metric and as a lint count.

    Every eleventh value of the metric is unmeasured in one year, to try the rules of nulls. A lint has no
    row where it was not found, here with up to three line items.
    """
    rows = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == year).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    part = F.col("l_partkey").cast("string")
    metric = rows.select(
        F.concat(F.lit("cyclomatic@p"), part).alias("id"), F.lit("cyclomatic").alias("metric"), F.concat(F.lit("p"), part).alias("entity"),
        F.when((F.col("l_partkey") % 11 == 0) & F.lit(year == 1996), None).otherwise(F.col("n")).alias("value"),
        F.lit(4).cast("long").alias("target"), F.lit(1).cast("long").alias("scale"), F.lit("lower").alias("direction"),
    )
    lint = rows.where("n > 3").select(
        F.concat(F.lit("dead_code@p"), part).alias("id"), F.lit("dead_code").alias("metric"), F.concat(F.lit("p"), part).alias("entity"),
        F.col("n").alias("value"), F.lit(0).cast("long").alias("target"), F.lit(1).cast("long").alias("scale"), F.lit("lower").alias("direction"),
    )
    return metric.unionByName(lint)

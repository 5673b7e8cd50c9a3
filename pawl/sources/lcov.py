"""Coverage tracefiles in lcov's format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pawl.functions.columns import repo_relative


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(trace, block, ord, line) of each tracefile; a block is what one task reads of it, named by its
    first byte, and ord rises along a block."""
    text = spark.read.text(path)
    place = F.col("_metadata")
    return text.select(place["file_path"].alias("trace"), place["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))


#: A window over blocks holds as many of them as this number of bits can tell apart.
BITS = 16


def carried(ends: DataFrame, levels: int = 4) -> DataFrame:
    """Adds carried to the ends (trace, block, end) of blocks: the last end of the trace's blocks before it.

    block: a long that names no two blocks of a trace. Blocks that differ in their last bits only are a bucket,
    and a bucket's end is its last block's; buckets are blocks of the next level. So no task holds a trace.
    """
    order = lambda *keys: Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda over: F.last("end", ignorenulls=True).over(over)
    if levels == 1:
        return ends.withColumn("carried", last(order("trace")))
    # one shuffle, for the window and for the next level
    dealt = ends.withColumn("bucket", F.shiftright("block", BITS)).repartition("trace", "bucket")
    known = F.when(F.col("end").isNotNull(), F.col("block"))
    upper = carried(dealt.groupBy("trace", F.col("bucket").alias("block")).agg(F.max_by("end", known).alias("end")), levels - 1)
    above = upper.select(F.col("trace").alias("t"), F.col("block").alias("b"), F.col("carried").alias("above"))
    inside = dealt.withColumn("inside", last(order("trace", "bucket")))
    # null-safe, as a plain join would filter nulls below the shuffle, on one side only, and so do it twice
    rows = inside.join(above, F.col("trace").eqNullSafe(F.col("t")) & F.col("bucket").eqNullSafe(F.col("b")))
    return rows.select("trace", "block", "end", F.coalesce("inside", "above").alias("carried"))


def with_file(lines: DataFrame, root: str) -> DataFrame:
    """Adds file, the source of the record that a line stands in, and before, that of the line before it;
    both are null outside records.

    The last source of each block is carried to the blocks behind it over the table of blocks, bucket by
    bucket, so a trace of any length is read by many tasks.
    """
    raw = F.substring("line", 4, 1 << 30)
    marker = F.when(F.startswith("line", F.lit("SF:")), F.struct(repo_relative(raw, root).alias("file"))).when(
        F.col("line") == "end_of_record", F.struct(F.lit(None).cast("string").alias("file"))
    )
    marked = lines.withColumn("marker", marker)
    ends = marked.groupBy("trace", "block").agg(F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("ord"))).alias("end"))
    before = carried(ends.withColumn("block", F.col("block").cast("long"))).select(F.col("trace").alias("t"), F.col("block").alias("b"), "carried")
    rows = marked.join(before, (F.col("trace") == F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b")
    inside = Window.partitionBy("trace", "block").orderBy("ord")
    upto, short_of = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    state = lambda over: F.coalesce(F.last("marker", ignorenulls=True).over(over), F.col("carried"))["file"]
    return rows.withColumn("file", state(upto)).withColumn("before", state(short_of)).drop("marker", "carried")


def number(text) -> F.Column:
    """An unsigned number, 0 if it is none."""
    return F.coalesce(F.when(text.rlike("^\\+?[0-9]+$"), F.try_to_number(F.regexp_replace(text, "^\\+", ""), F.lit("9" * 19))).cast("long"), F.lit(0).cast("long"))


def records(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(file, line, hits) of each DA line inside a record; numbers that cannot be read are 0."""
    return line_records(lines_of(spark, path), root)


def line_records(lines: DataFrame, root: str = "") -> DataFrame:
    """(file, line, hits) of lines as lines_of gives them."""
    data = with_file(lines, root).where(F.startswith("line", F.lit("DA:")) & F.col("file").isNotNull())
    fields = F.split(F.substring("line", 4, 1 << 30), ",", -1)
    hits = F.coalesce(F.get(fields, F.lit(1)), F.lit("0"))
    return data.select("file", number(fields[0]).alias("line"), number(hits).alias("hits"))


def faults(spark: SparkSession, path: str, sources: DataFrame, root: str = "") -> DataFrame:
    """(ord, fault) of everything that a strict reader refuses; no rows for a sound trace.

    sources: one column file, the files that exist below the root.
    """
    rows = with_file(lines_of(spark, path), root)
    rows = rows.join(sources.select(F.col("file").alias("known")).distinct(), F.col("file") == F.col("known"), "left")
    start, data, end = F.startswith("line", F.lit("SF:")), F.startswith("line", F.lit("DA:")), F.col("line") == "end_of_record"
    fields = F.split(F.substring("line", 4, 1 << 30), ",", -1)
    digits = "^\\+?[0-9]+$"
    bad_number = ~fields[0].rlike(digits) | (number(fields[0]) == 0) | ~F.coalesce(F.get(fields, F.lit(1)).rlike(digits), F.lit(False))
    fault = (
        F.when(start & (F.col("before").isNotNull() | (F.length("line") == 3)), "a record starts inside a record or names no source")
        .when(start & F.col("known").isNull(), "a source is missing or outside the root")
        .when(data & F.col("file").isNull(), "a line stands outside records")
        .when(data & bad_number, "a line number or hit count is not a number")
        .when(end & F.col("before").isNull(), "a record ends that did not start")
    )
    found = rows.select("ord", fault.alias("fault")).where("fault IS NOT NULL")
    last = rows.groupBy("trace").agg(F.max_by("file", F.struct("block", "ord")).alias("open"), F.count_if(data).alias("n"), F.max("ord").alias("ord"))
    unfinished = last.where("open IS NOT NULL OR n = 0").select("ord", F.lit("the trace is unfinished or has no lines").alias("fault"))
    return found.union(unfinished)

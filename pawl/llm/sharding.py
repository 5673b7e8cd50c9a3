"""Proportional stratified interleaving of rows into shards, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pawl.llm.common import durable, quoted


def with_before(counts: DataFrame, keys: Sequence[str], place: str, fan: int = 1024) -> DataFrame:
    """Adds before, the sum of `rows` of all earlier places of the same keys.

    Sums go over runs of `fan` places and then within a run, so that no task sorts all places.
    """
    run = F.expr(f"{place} div {fan}")
    runs = counts.groupBy(*keys, run.alias("run")).agg(F.sum("rows").alias("run_rows"))
    earlier = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_before", F.coalesce(F.sum("run_rows").over(earlier), F.lit(0))).drop("run_rows")
    inside = Window.partitionBy(*keys, "run").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    found = counts.withColumn("run", run).join(runs, [*keys, "run"])
    return found.withColumn("before", F.col("run_before") + F.coalesce(F.sum("rows").over(inside), F.lit(0))).drop("run", "run_before")


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Adds copy: 0, 1, 2, ... within rows alike in `same`, and 0 for a row that has no like.

    Only rows that have one are numbered, within their input partition (`part`) and counted from one
    partition to the next, so that a row repeated without end is spread over as many tasks as it came in.
    """
    counts = rows.groupBy("same", "part").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("same")
    repeated = counts.withColumn("all", F.sum("rows").over(whole)).where("all > 1").select("same", "part", "rows")
    repeated = durable(with_before(repeated, ["same"], "part").select(F.col("same").alias("s"), F.col("part").alias("p"), "before"))
    marked = rows.join(repeated, (F.col("same") == F.col("s")) & (F.col("part") == F.col("p")), "left").drop("s", "p")
    once = marked.where("before IS NULL").withColumn("copy", F.lit(0).cast("long"))
    within = Window.partitionBy("same", "part").orderBy("same")
    again = marked.where("before IS NOT NULL").withColumn("copy", F.col("before") + F.row_number().over(within) - 1)
    return once.union(again.select(*once.columns)).drop("before")


def interleave(
    docs: DataFrame,
    n_shards: int = 24,
    seed: int = 20240501,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_bucket: int = 1024,
) -> DataFrame:
    """Deal rows into shards of equal row counts that each hold the sources in their overall shares.

    The rows of each source are shuffled by a seeded hash of id, size and CRC (and the number of the
    copy among rows alike in all of these) and ranked; rank r of n has the fractional rank
    (2r + 1) / 2n. All rows are sorted by it, ties by source, and cut into n_shards runs whose lengths
    differ by one at most.

    Both rankings are exact and no task holds a whole source: a row falls in a bucket by its hash
    (then by its fractional rank), buckets are counted, the counts of earlier buckets are summed over
    the table of buckets in two levels, and rows are numbered inside a bucket only. Texts are read
    once; what follows works on rows of a few numbers.

    A null source is a stratum of its own. A null text has size 8 and CRC 0. Repeated rows, null ids
    and ids that repeat with other texts are spread like all others; rows alike in id, size, CRC and
    source may swap places, which changes no result. Long texts cost no more than their size. An empty
    table gives an empty result. Other columns of the input are ignored. Returns doc_id, size,
    text_crc32, law, shard, slot, grown_shard, source, source_rank.
    """
    text = quoted(text_col).cast("string")
    rows = durable(
        docs.select(
            quoted(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            quoted(source_col).cast("string").alias("source"),
        )
        .withColumn("stratum", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
        .withColumn("same", F.xxhash64("stratum", F.col("doc_id").cast("string"), "size", "text_crc32"))
        .withColumn("part", F.spark_partition_id())
    )
    total = rows.count()
    buckets = max(1, -(-total // rows_per_bucket))
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "size", "text_crc32", "copy")
    bucket = F.floor(F.shiftrightunsigned("hashed", 33) * F.lit(buckets) / F.lit(float(1 << 31)))
    rows = durable(numbered_copies(rows).withColumn("hashed", hashed).withColumn("bucket", bucket.cast("long")).drop("same", "part"))

    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    sizes = counts.groupBy("stratum").agg(F.sum("rows").alias("stratum_rows"))
    offsets = with_before(counts, ["stratum"], "bucket").join(sizes, "stratum").drop("rows")
    inside = Window.partitionBy("stratum", "bucket").orderBy("hashed", "doc_id", "text_crc32", "size", "copy")
    ranked = (
        rows.join(offsets, ["stratum", "bucket"])
        .withColumn("source_rank", F.col("before") + F.row_number().over(inside) - 1)
        .withColumn("turn", (2 * F.col("source_rank") + 1) / (2 * F.col("stratum_rows")))
        .select(
            "doc_id", "size", "text_crc32", "source", "stratum", "source_rank", "turn",
            F.floor(F.col("turn") * F.lit(buckets)).cast("long").alias("bucket"),
        )
    )
    ranked = durable(ranked)
    starts = with_before(ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")), [], "bucket").drop("rows")
    order = Window.partitionBy("bucket").orderBy("turn", "stratum", "source_rank")
    place = F.col("before") + F.row_number().over(order) - 1
    shard = F.expr(f"place * {n_shards} div {max(total, 1)}")
    start = F.expr(f"(shard * {max(total, 1)} + {n_shards - 1}) div {n_shards}")
    return (
        ranked.join(starts, "bucket")
        .withColumn("place", place)
        .withColumn("shard", shard)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("place") - start).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "source",
            "source_rank",
        )
    )


def write_shards(docs: DataFrame, dealt: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of docs as one folder for each shard, in slot order. Ids must be unique."""
    places = dealt.select(F.col("doc_id").alias("__dealt_id"), "shard", "slot")
    kept = docs.select(*[quoted(c) for c in docs.columns if c not in ("shard", "slot")])
    joined = kept.join(places, quoted(id_col).eqNullSafe(F.col("__dealt_id"))).drop("__dealt_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

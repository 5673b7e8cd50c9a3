"""Connected components of an undirected graph, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pawl.llm.common import discard, durable


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of `edges` (columns a, b), as (node, component).

    Every round points each node's neighbours and the node itself to the smallest of them, first to
    the larger neighbours and then to the smaller ones, until nothing changes; the number of rounds
    grows with the logarithm of the number of nodes. Each round is cut off by a checkpoint, and the
    checkpoints of the round before are deleted; nothing but two sums comes to the driver. Minima are taken before the shuffle. They are dealt anew before
    the joins back to them, as adaptive execution splits a hot key only of a join that shuffles both
    its sides. Loops and repeated edges are
    ignored; null ends are dropped.
    """
    kept = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = durable(kept.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # large star: of each node, larger neighbours go to the smallest of node and neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")).hint("rebalance")
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u <> v").distinct())
        # small star: of each node, smaller neighbours and the node go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w").hint("rebalance")
        moved = large.join(least, F.col("u") == F.col("w")).select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, links = links, durable(moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        discard(old, large)
        now = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    nodes = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

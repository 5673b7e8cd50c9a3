"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pawl.llm.common import durable, quoted
from pawl.llm.components import connected_components

WIDTH = 2.0
#: The chance that a pair at the threshold shares no bucket, at most.
MISSED = 0.002
#: Classes of a bucket that are compared with as many others at most, and rows that a task takes, about.
BLOCK = 1024
TASK_ROWS = 8192


def collision(distance: float, width: float) -> float:
    """The chance that one projection, cut into cells of `width`, puts two points of a distance in one cell."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, width: float = WIDTH, missed: float = MISSED) -> tuple[int, int]:
    """Projections of a table and tables for n vectors.

    As many projections as leave a vector one chance partner (at right angles to it) in a bucket, 4 at
    least, and as many tables as a pair at the threshold needs to share a bucket of one of them. So work
    grows with n to the power of 1.23 at 0.93: partners of a table stay few, and tables grow slowly.
    """
    projections = max(4, math.ceil(math.log(max(n, 2)) / -math.log(collision(math.sqrt(2), width))))
    near = collision(math.sqrt(max(0.0, 2 - 2 * threshold)), width) ** projections
    return projections, max(1, math.ceil(math.log(missed) / math.log1p(-near))) if near < 1 else 1


def unit(flat: np.ndarray, dimensions: int) -> np.ndarray:
    x = np.asarray(flat, "f8").reshape(-1, dimensions)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bucket_keys(x: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """A key for each unit vector and table: the quantised projections h = floor((a.x + b) / w), mixed."""
    random = np.random.default_rng([seed, x.shape[1]])
    a, b = random.normal(size=(x.shape[1], tables * projections)), random.uniform(0, width, tables * projections)
    cells = np.floor((x @ a + b) / width).astype("i8").astype("u8").reshape(len(x), tables, projections)
    key = np.full((len(x), tables), x.shape[1], "u8")
    for k in range(projections):
        key = (key ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view("i8")


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of places inside runs of these sizes, run after run."""
    starts = np.cumsum(sizes) - sizes
    after = np.repeat(starts + sizes, sizes) - np.arange(sizes.sum()) - 1  # partners behind each place
    i = np.repeat(np.arange(len(after)), after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    width: float = WIDTH,
    missed: float = MISSED,
    block: int = BLOCK,
    task_rows: int = TASK_ROWS,
    seed: int = 11,
) -> DataFrame:
    """Links and components of vectors of equal label whose cosine is at least the threshold.

    Equal vectors of a label are one class and one node from the start, under a number of its own.
    Every class is hashed into tables of quantised random projections of its unit vector; plan() takes
    their numbers from the size of the largest label, so that chance partners stay few at any size and
    a pair at the threshold is missed with a chance of `missed` at most. Buckets are first found from
    keys alone; only vectors that share one travel. Classes of a bucket are compared by cosine in
    double precision, many buckets to a task. A pair counts in the first table only in which it shares a
    bucket, so links are exact for the pairs found; a task gives counts and the edges of a spanning
    forest, never pairs. A bucket of more than `block` classes is compared in pairs of blocks, each by
    another task.

    A vector that is null, empty, zero or holds a null or a non-finite component, and one whose id
    or label is null, links with nothing. Vectors of different lengths never meet. Repeated rows, also
    of one id with different vectors, are vectors of their own. An empty table gives an empty result.
    Other columns are ignored. Returns vec_id, n_links, component_id, kept (vec_id = component_id),
    for each row.
    """
    label = quoted(label_col) if label_col else F.lit(0)
    rows = vectors.select(quoted(id_col).alias("vec_id"), label.alias("label"), quoted(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()

    def packed(batches):
        for batch in batches:
            lists = batch.column(2)
            flat, bounds = np.asarray(lists.values, "f8") + 0.0, np.asarray(lists.offsets)
            data = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), lists], names=["vec_id", "label", "digest", "embedding"])

    simple = {f.name: f.dataType.simpleString() for f in rows.schema}
    good = rows.where(usable).mapInArrow(packed, f"vec_id {simple['vec_id']}, label {simple['label']}, digest binary, embedding {simple['embedding']}")
    sets = good.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    # numbers are settled by the checkpoint
    classes = durable(sets.withColumn("node", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    projections, tables = plan(largest, threshold, width, missed)

    def hashed(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes, flat = np.diff(np.asarray(lists.offsets)), np.asarray(lists.values, "f8")
            starts = np.asarray(lists.offsets)[:-1]
            keys = np.empty((batch.num_rows, tables), "i8")
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for own in np.array_split(at, len(at) // 1000 + 1):
                    keys[own] = bucket_keys(unit(flat[starts[own][:, None] + np.arange(size)], size), tables, projections, width, seed)
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype="i4")), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), column], names=["label", "node", "keys"])

    keyed = classes.select("label", "embedding", "node").mapInArrow(hashed, f"label {simple['label']}, node long, keys array<long>")
    slim = keyed.select("node", F.posexplode("keys").alias("nth", "key"), "label").select("node", "nth", F.xxhash64("label", "nth", "key").alias("place"), "label")
    shared = durable(slim.groupBy("place", "nth", "label").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    total = shared.agg(F.sum("members"), F.sum(F.ceil(F.col("members") / block) * F.col("members"))).first()[1] or 0
    tasks = max(1, -(-int(total) // task_rows))
    placed = (
        slim.join(shared, ["place", "nth", "label"])
        .withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        # a row of block k goes to every pair of blocks with k
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
    )
    group = F.xxhash64("place", "nth", "label", "low", "high")
    # not the bits that deal the groups to partitions
    placed = placed.select("node", "nth", "own", (F.col("low") != F.col("high")).alias("across"), group.alias("grp"), F.pmod(F.xxhash64(F.lit("task"), group), F.lit(tasks)).alias("task"))
    sent = placed.join(classes.select("node", "copies", "embedding"), "node")

    def compared(found: pa.Table) -> pa.Table:
        grp = np.asarray(found["grp"], "i8")
        node, nth, own = (np.asarray(found[c], "i8") for c in ("node", "nth", "own"))
        across, copies = np.asarray(found["across"]), np.asarray(found["copies"], "i8")
        lists = found["embedding"].combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        links, edges = [], []
        # vectors of one length at a time: other lengths never share a bucket but by a collision of hashes
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            at = at[np.lexsort((node[at], grp[at]))]
            x = unit(np.asarray(lists.values, "f8")[np.asarray(lists.offsets)[:-1][at][:, None] + np.arange(size)], size)
            runs = np.unique(grp[at], return_counts=True)[1]
            keys, have = np.empty((len(at), tables), "i8"), np.zeros(len(at), bool)
            for i, j in candidate_pairs(runs, x, threshold):
                keep = ~across[at[i]] | (own[at[i]] != own[at[j]])
                i, j = i[keep], j[keep]
                if len(i):
                    need = np.unique(np.concatenate([i, j]))
                    need = need[~have[need]]
                    keys[need], have[need] = bucket_keys(x[need], tables, projections, width, seed), True
                    fresh = np.concatenate([first_shared(keys, i[k : k + 50_000], j[k : k + 50_000]) for k in range(0, len(i), 50_000)]) == nth[at[i]]
                    links.append((at[i[fresh]], at[j[fresh]]))
                    edges.append((node[at[i[fresh]]], node[at[j[fresh]]]))
        a, b = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, "i8") for k in (0, 1))
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        counts, up = np.zeros(len(names), "i8"), list(range(len(names)))
        p, q = place[: len(a)], place[len(a) :]
        if links:
            np.add.at(counts, p, copies[np.concatenate([x[1] for x in links])])
            np.add.at(counts, q, copies[np.concatenate([x[0] for x in links])])
        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            i, j = top(up, i), top(up, j)
            if i != j:
                up[max(i, j)] = min(i, j)
        roots = [top(up, k) for k in range(len(names))]
        return pa.table({"node": pa.array(names, pa.int64()), "root": pa.array(names[roots], pa.int64()), "links": pa.array(counts, pa.int64())})

    linked = durable(sent.groupBy("task").applyInArrow(compared, "node long, root long, links long"))
    components = connected_components(linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        classes.select("label", "digest", "rep", "copies", "node")
        .join(sums, "node", "left")
        .join(components.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
        .select(F.col("label").alias("l"), F.col("digest").alias("d"), "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    known = durable(known)
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    mine = good.select("vec_id", "label", "digest").join(known.join(least, "component"), (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")))
    rest = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.select("vec_id", "n_links", "component_id").union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def top(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def first_shared(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first table in which both share a bucket."""
    return (keys[i] == keys[j]).argmax(axis=1)


def candidate_pairs(runs: np.ndarray, x: np.ndarray, threshold: float, small: int = 48, most: int = 100_000):
    """Places i < j inside one run whose cosine is at least the threshold, in portions.

    Runs of few rows are taken together, pair by pair; of long ones the products of all rows.
    """
    starts = np.cumsum(runs) - runs
    short = np.flatnonzero((runs > 1) & (runs <= small))
    bounds = np.cumsum(runs[short] * (runs[short] - 1) // 2)
    for own in np.split(short, np.searchsorted(bounds, np.arange(most, bounds[-1] if len(bounds) else 0, most))):
        if len(own):
            rows = np.concatenate([np.arange(starts[r], starts[r] + runs[r]) for r in own.tolist()])
            i, j = pairs_within(runs[own])
            i, j = rows[i], rows[j]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            yield i[near], j[near]
    for r in np.flatnonzero(runs > small).tolist():
        y = x[starts[r] : starts[r] + runs[r]]
        for begin in range(0, len(y), 256):
            i, j = np.nonzero(y[begin : begin + 256] @ y.T >= threshold)
            near = i + begin < j
            yield i[near] + begin + starts[r], j[near] + starts[r]

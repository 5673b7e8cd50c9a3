"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pawl.llm.common import broadcast_if_small, durable, map_texts, quoted
from pawl.llm.components import connected_components

CHUNKS = 11
CHUNK_SYMBOLS = 6
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: Signatures of this distance or less are candidates: by pigeonhole one of 11 chunks then differs
#: in one symbol at most. At a similarity of 0.85 a pair is farther apart with a chance of 1.5e-4;
#: plan() has the numbers for other similarities.
DISTANCE = 21
#: The chance of a pair at the limit to be farther apart than compared, at most; chunks at most.
MISSED = 1.6e-4
MOST_CHUNKS = 16
#: Signatures that a task compares with as many others, and documents that it compares exactly.
SIGNATURE_BLOCK = 2048
DOCUMENT_BLOCK = 384

MARK_ID, MARK_DIGEST = "__pawl_id", "__pawl_digest"

_random = np.random.default_rng(23)
XOR = _random.integers(0, 1 << 63, SYMBOLS, dtype="u8") * np.uint64(2) + np.uint64(1)
MULTIPLY = _random.integers(0, 1 << 63, SYMBOLS, dtype="u8") * np.uint64(2) + np.uint64(1)
_more = _random.integers(0, 1 << 63, (2, MOST_CHUNKS * CHUNK_SYMBOLS - SYMBOLS), dtype="u8") * np.uint64(2) + np.uint64(1)
XOR, MULTIPLY = np.concatenate([XOR, _more[0]]), np.concatenate([MULTIPLY, _more[1]])


def missed(chunks: int, chunk_symbols: int, percent: int) -> float:
    """The chance that signatures of sets of a similarity differ in more than 2 * chunks - 1 symbols."""
    n, q = chunks * chunk_symbols, (100 - percent) / 100 * 255 / 256
    return sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(2 * chunks, n + 1))


def plan(percent: int) -> tuple[int, int]:
    """Chunks and symbols of a chunk: the longest chunks, then the fewest, that miss MISSED at most."""
    for size in range(CHUNK_SYMBOLS, 1, -1):
        for chunks in range(CHUNKS, MOST_CHUNKS + 1):
            if missed(chunks, size, percent) <= MISSED:
                return chunks, size
    return MOST_CHUNKS, 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """The distinct shingles of `size` words as ascending 64-bit hashes; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, "u8")
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    width = min(size, len(words))
    out = mixed(hashed[: len(words) - width + 1] + np.uint64(width))
    for k in range(1, width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : len(words) - width + 1 + k])
    return np.unique(out)


def set_key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def signatures(sets: list[np.ndarray], symbols: int = SYMBOLS) -> np.ndarray:
    """8-bit symbols for each set: mixed low bits of the least shingle under each permutation."""
    out = np.zeros((len(sets), symbols), "u1")
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full])
        sizes = np.array([len(sets[k]) for k in full])
        starts = np.cumsum(sizes) - sizes
        for i in range(symbols):
            least = np.minimum.reduceat(mixed_once(flat, i), starts)
            out[full, i] = mixed(least) & np.uint64(255)
    return out


def mixed_once(flat: np.ndarray, i: int) -> np.ndarray:
    x = (flat ^ XOR[i]) * MULTIPLY[i]
    return x ^ (x >> np.uint64(31))


def chunk_keys(signature: np.ndarray, n_chunks: int = CHUNKS, size: int = CHUNK_SYMBOLS) -> np.ndarray:
    """A key for each chunk and each symbol of it left out: two chunks share a key if they differ
    in one symbol at most. The key holds the other symbols whole, so it has no collisions."""
    chunks = signature.reshape(len(signature), n_chunks, size).astype("i8")
    out = np.empty((len(signature), n_chunks, size), "i8")
    for skipped in range(size):
        key = np.arange(n_chunks)[None, :] * size + skipped + np.zeros((len(signature), 1), "i8")
        for k in range(size):
            if k != skipped:
                key = key << 8 | chunks[:, :, k]
        out[:, :, skipped] = key
    return out.reshape(len(signature), -1)


class Forest:
    """Union-find over places 0 to n - 1; the root is the smallest place."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)

    def edges(self, names: pa.Array) -> pa.Table:
        """(a, b) for every place that has another root."""
        tops = [self.top(i) for i in range(len(self.root))]
        moved = [i for i, t in enumerate(tops) if i != t]
        return pa.table({"a": names.take(pa.array(moved, pa.int64())), "b": names.take(pa.array([tops[i] for i in moved], pa.int64()))})


def close_signatures(found: pa.Table, distance: int = DISTANCE) -> pa.Table:
    """A spanning forest of the pairs of signatures that are `distance` or less apart."""
    found = found.combine_chunks()
    sig = np.frombuffer(b"".join(found["sig"].to_pylist()), "u1").reshape(found.num_rows, -1)
    across = found["low"][0].as_py() != found["high"][0].as_py()
    own = np.asarray(found["own"])
    forest = Forest(found.num_rows)
    step = max(1, (1 << 22) // max(1, found.num_rows))
    for begin in range(0, found.num_rows, step):
        here = sig[begin : begin + step]
        apart = np.zeros((len(here), found.num_rows), "u1")
        for k in range(sig.shape[1]):
            apart += here[:, k, None] != sig[None, :, k]
        i, j = np.nonzero(apart <= distance)
        i += begin
        keep = (i < j) & (own[i] != own[j]) if across else i < j
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            forest.join(x, y)
    return forest.edges(found["node"].combine_chunks())


def similar_sets(sets: list[np.ndarray], own: np.ndarray, across: bool, percent: int) -> Forest:
    """Link sets with 100 * intersection >= percent * union, by exact intersections of all pairs."""
    forest = Forest(len(sets))
    sizes = np.array([len(s) for s in sets], "i8")
    flat = np.concatenate(sets) if sets else np.zeros(0, "u8")
    whose = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    place = np.cumsum(counts > 1) - 1
    column, whose = place[inverse[shared]], whose[shared]
    common = np.zeros((len(sets), len(sets)), "f4")
    at = np.argsort(column, kind="stable")
    column, whose = column[at], whose[at]
    width = 4096
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        block = np.zeros((len(sets), width), "f4")
        block[whose[lo:hi], column[lo:hi] - begin] = 1.0
        common += block @ block.T
    inter = common.astype("i8")
    # sets without a shared shingle keep 0; sets have fewer than 2**24 shared shingles a block, summed exactly
    either = sizes[:, None] + sizes[None, :] - inter
    i, j = np.nonzero((100 * inter >= percent * either) & (either > 0))
    keep = (i < j) & (own[i] != own[j]) if across else i < j
    for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
        forest.join(x, y)
    return forest


def in_blocks(rows: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """Rows of large groups dealt into blocks, each row sent to every pair of blocks with its own.

    Groups of `block` rows or fewer are one pair (0, 0). Adds own, low and high.
    """
    counts = durable(rows.groupBy(group).agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    counts = counts.select(group, F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    return (
        rows.join(counts, group)
        .withColumn("own", F.pmod(F.xxhash64(F.lit("block"), member), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .drop("other", "blocks")
    )


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    1. One pass makes each text's number of shingles, a 128-bit hash of its set and its signature
       of 8-bit symbols, 66 at 85 percent and 70 at 80. Equal sets are one class and one node of all
       that follows, under a number of its own: however often an id or a text repeats, it is one row.
    2. Each class has a key for every chunk and every symbol left out of it. The least class of a
       shared key leads it; classes are gathered by leader and compared by signature distance.
    3. The components of close signatures bring the sets of their classes together once, and they
       are compared in full. Components of these links are the result.
    Leaders' groups and components of many rows are compared in pairs of blocks, each by a task of
    its own. Groups give spanning forests, never their pairs; no link between the compared is lost.
    The number of symbols and the distance follow from percent: the chance that a pair at the limit
    lies beyond the distance is MISSED at most (9e-5 at 80 percent, 1.5e-4 at 85).

    A document without words, with a null text or a null id is linked with nothing. Repeated rows
    are equal sets. Rows of one id with different texts are judged each by its own text, and a
    component is named by its least id. Whole texts count, however long. An empty table gives an
    empty result. Columns of docs are ignored but for those that `carry` names, which are passed on.
    Returns for each row doc_id, n_shingles, component_id, kept, and the columns of `carry`.
    """
    found = components_of(docs, shingle_words, percent, id_col, text_col, carry)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), *carry)


def components_of(docs: DataFrame, shingle_words: int, percent: int, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    """doc_id, n_shingles, component_id, component (a number, null where nothing can be linked), carry."""
    n_chunks, chunk_symbols = plan(percent)
    outputs = [
        ("n_shingles", T.LongType(), pa.int64()),
        ("set_key", T.BinaryType(), pa.binary()),
        ("sig", T.BinaryType(), pa.binary()),
    ]

    def make():
        def work(texts):
            sets = [shingle_set(words_of(t), shingle_words) for t in texts]
            return [len(s) for s in sets], list(map(set_key, sets)), [r.tobytes() for r in signatures(sets, n_chunks * chunk_symbols)]

        return work

    named = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"), *[quoted(c) for c in carry])
    signed = durable(map_texts(named, "text", outputs, make, ["doc_id", *carry]))
    usable = "doc_id IS NOT NULL AND n_shingles > 0"
    sets = signed.where(usable).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    # numbers are settled by the checkpoint
    classes = durable(sets.withColumn("node", F.monotonically_increasing_id()))

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "u1").reshape(batch.num_rows, -1)
                keys = chunk_keys(sig, n_chunks, chunk_symbols)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype="i4")), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "keys"])

    keys = classes.select("node", "sig").mapInArrow(keyed, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    leaders = durable(keys.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "leader"))
    gathered = durable(keys.join(leaders.hint("shuffle_hash"), "key").select("leader", "node").distinct())
    blocks = in_blocks(gathered.join(classes.select("node", "sig"), "node"), "leader", "node", SIGNATURE_BLOCK)

    def close_ones(found: pa.Table) -> pa.Table:
        return close_signatures(found, 2 * n_chunks - 1)

    candidates = blocks.groupBy("leader", "low", "high").applyInArrow(close_ones, "a long, b long")
    close = connected_components(candidates).join(classes.select("node", "set_key", "rep"), "node")
    close = durable(close.select("node", "component", F.col("set_key").alias("wanted_key"), F.col("rep").alias("wanted_id")))

    # one text stands for a class; rows of its id with other texts drop out by their sets
    wanted = broadcast_if_small(durable(close.select("wanted_id").distinct()))
    standing = named.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("wanted_id"), "left_semi")

    def make_sets():
        def work(texts):
            sets = [shingle_set(words_of(t), shingle_words) for t in texts]
            return list(map(set_key, sets)), [s.tobytes() for s in sets]

        return work

    with_sets = map_texts(standing, "text", [("set_key", T.BinaryType(), pa.binary()), ("set", T.BinaryType(), pa.binary())], make_sets, ["doc_id"])
    matched = with_sets.join(close, (F.col("doc_id") == F.col("wanted_id")) & (F.col("set_key") == F.col("wanted_key")))
    one_each = matched.groupBy("node", "component").agg(F.first("set").alias("set"))
    blocks = in_blocks(durable(one_each), "component", "node", DOCUMENT_BLOCK)

    def compared(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        sets = [np.frombuffer(s, "u8") for s in found["set"].to_pylist()]
        across = found["low"][0].as_py() != found["high"][0].as_py()
        return similar_sets(sets, np.asarray(found["own"]), across, percent).edges(found["node"].combine_chunks())

    links = blocks.groupBy("component", "low", "high").applyInArrow(compared, "a long, b long")
    linked = classes.join(durable(connected_components(links)).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    linked = linked.select(F.col("set_key").alias("k"), "rep", F.coalesce("component", "node").alias("component"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = durable(linked.join(least, "component").select("k", "component", "component_id"))
    mine = signed.where(usable).join(of_class, F.col("set_key") == F.col("k")).select("doc_id", "n_shingles", "component_id", "component", *carry)
    rest = signed.where(f"NOT ({usable})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"), *carry)
    return mine.union(rest)


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each component: the least id, of its texts the one of the least MD5.

    Rows of one id and one text are one document and stay once; rows of one id with different texts
    are documents of their own, each kept or dropped by its own text. Rows without words or without
    an id are in no component and all stay. All columns are returned as they came.
    """
    digest = F.md5(F.encode(quoted(text_col).cast("string"), "UTF-8"))
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"), digest.alias("digest"))
    found = components_of(rows, shingle_words, percent, "doc_id", "text", ["digest"]).where("component IS NOT NULL")
    # texts of a component with their rows; all go but the best, and of its rows all but one
    texts = durable(found.groupBy("component", "doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")))
    best = texts.groupBy(F.col("component").alias("of")).agg(F.min(F.struct("doc_id", "digest")).alias("x"))
    judged = texts.join(best, F.col("component") == F.col("of")).select(
        F.col("doc_id").alias("i"), F.col("digest").alias("d"), "rows", (F.struct("doc_id", "digest") == F.col("x")).alias("best")
    )
    apart = durable(judged.where("NOT best OR rows > 1"))
    marked = docs.withColumn(MARK_ID, quoted(id_col)).withColumn(MARK_DIGEST, digest)
    same = (F.col(MARK_ID) == F.col("i")) & (F.col(MARK_DIGEST) == F.col("d"))
    twice = durable(apart.where("best").select("i", "d"))
    stay = marked.join(broadcast_if_small(apart.select("i", "d")), same, "left_anti")
    once = marked.join(broadcast_if_small(twice), same, "left_semi").dropDuplicates([MARK_ID, MARK_DIGEST])
    return stay.union(once).drop(MARK_ID, MARK_DIGEST)

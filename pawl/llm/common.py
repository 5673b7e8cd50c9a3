"""Reading tables, mapping texts in Arrow batches and cutting lineage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of text handed to Python at once; a batch is worked on in smaller slices of rows.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
SLICE_BYTES = 2 << 20

TEXT = "__pawl_text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark has to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches, so that a batch of long texts fits a worker.

    Spark reads them when a plan runs, so they stay lowered; limits below these are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub("[^-0-9]", "", spark.conf.get(key)))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    A folder of our own is made only where the setting is absent and the master is local.
    """
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pawl-checkpoint-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


_checkpoints: list[str] = []


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    _checkpoints.append(checkpoint_of(out))
    return out


#: Rows of a few numbers each that may be sent to every executor.
BROADCAST_ROWS = 400_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed frame of narrow rows, to be broadcast if it has no more than `rows` of them.

    Without the hint the other side of a join, which may hold whole texts, is dealt out before its size
    is known to be small; beyond the bound it has to be.
    """
    return F.broadcast(df) if df.count() <= rows else df


def checkpoint_of(df: DataFrame) -> str:
    """The folder of a frame that durable() has made."""
    return df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system; a folder that is gone already is no fault."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete the checkpoints of frames that nothing will read again."""
    for df in frames:
        delete(df.sparkSession, checkpoint_of(df))


@contextmanager
def scratch(spark: SparkSession):
    """Checkpoints made inside are deleted at the end, when the results have been written."""
    before = len(_checkpoints)
    try:
        yield
    finally:
        while len(_checkpoints) > before:
            delete(spark, _checkpoints.pop())


def quoted(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, outputs: Sequence[str], carry: Sequence[str] | None) -> list[str]:
    """Input columns to pass on; a column that has an output's name gives way to the output."""
    taken = {x.lower() for x in outputs}
    return [c for c in (df.columns if carry is None else carry) if c.lower() not in taken]


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold SLICE_BYTES at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > SLICE_BYTES:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if sizes:
        yield batch.slice(start)


_held: dict[str, object] = {}


def let_go() -> None:
    """Free what this worker process holds, and give its unused memory back to the system."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def hold(key: str, build: Callable[[], object]) -> object:
    """What build() makes, kept in this worker process for later tasks of the same key.

    Workers outlive tasks and serve one operator after another; taking hold of another key lets go
    of what was held before, so that the operators' caches never add up.
    """
    if key not in _held:
        let_go()
        _held[key] = build()
    return _held[key]


def holding(work):
    """Marks a function that map_texts may run beside what is held."""
    work.holds = True
    return work


def map_texts(
    df: DataFrame,
    text_col: str,
    outputs: Sequence[tuple[str, T.DataType, pa.DataType]],
    make: Callable[[], Callable[[list[str | None]], Sequence]],
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns computed from a text column, batch by batch, without a shuffle.

    make() runs once in each task and returns a function from a list of texts to one sequence or
    Arrow array for each output. carry names the input columns to keep (all by default).
    """
    small_batches(df.sparkSession)
    names = [name for name, _, _ in outputs]
    kept = carried(df, names, carry)
    sent = [quoted(c) for c in kept]
    # a text column that is kept is sent once, another one beside those that are kept
    own = kept.index(text_col) if text_col in kept and isinstance(df.schema[text_col].dataType, T.StringType) else len(kept)
    if own == len(kept):
        sent.append(quoted(text_col).cast("string").alias(TEXT))
    source = df.select(*sent)
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(n, kind, True) for n, kind, _ in outputs])
    arrow = [kind for _, _, kind in outputs]
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        if not getattr(work, "holds", False):
            let_go()
        for batch in batches:
            for part in slices(batch, own):
                found = work(part.column(own).to_pylist())
                columns = [part.column(i) for i in range(n_kept)]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(found, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=kept + names)

    return source.mapInArrow(run, schema)

"""Rust files as rows, and their measurements as columns. A file is one unit of work, and equal files are one."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pawl.functions.columns import function_key, is_test_path

COUNTS = ["cyclomatic", "cognitive", "unsafe_count", "panic_count", "allow_count", "bare_panic_count", "bare_allow_count", "pub_wrapper_count", "get_prefix_count"]
FUNCTION = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType()), T.StructField("halstead_difficulty", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in COUNTS]
)
FILE = T.StructType([T.StructField("loc", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in ("allow_count", "bare_allow_count", "deny_warnings_count")])
FACT = T.StructType([T.StructField("fact", T.StringType()), T.StructField("name", T.StringType())])
CONTRACT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
MEASURED = T.StructType(
    [
        T.StructField("functions", T.ArrayType(FUNCTION)),
        T.StructField("file_counts", FILE),
        T.StructField("error_facts", T.ArrayType(FACT)),
        T.StructField("malformed", T.StringType()),
    ]
)


#: Characters of contents whose results a task remembers at most.
REMEMBERED = 16 << 20


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows, dealt by their keys over all cores.

    For narrow rows from which files or log lines are made: a small table is read by one task, however much
    work its rows are.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)


def each_once(work, most: int = REMEMBERED):
    """A function from an Arrow array of contents to (results of different contents, place of each row's result).

    Contents that are equal are worked on once in an array, and in later ones as long as they are
    remembered. Null content has nothing in it.
    """
    known: dict[str, dict] = {}
    held = 0

    def results(content: pa.Array) -> tuple[list[dict], pa.Array]:
        nonlocal held
        encoded = pc.fill_null(content, "").dictionary_encode()
        rows = []
        for text in encoded.dictionary.to_pylist():
            row = known.get(text)
            if row is None:
                row = work(text)
                if len(text) <= most:
                    if held + len(text) > most:
                        known.clear()
                        held = 0
                    known[text] = row
                    held += len(text)
            rows.append(row)
        return rows, encoded.indices

    return results


def _mapped(files: DataFrame, schema: T.StructType, work) -> DataFrame:
    """Appends the fields of what work(content) gives."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*files.schema.fields, *schema.fields])
    arrow, names = to_arrow_schema(schema), files.columns

    def run(batches):
        results = each_once(work)
        for batch in batches:
            rows, places = results(batch.column(names.index("content")))
            columns = [pa.array([r.get(f.name) for r in rows], f.type).take(places) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[f.name for f in out.fields])

    return files.mapInArrow(run, out)


def measured(files: DataFrame, qualify_traits: bool = False) -> DataFrame:
    """Adds functions, file_counts, error_facts and malformed (null unless the file cannot be parsed).

    files: file, content and others. Null content has nothing in it.
    """
    from pawl.rust import lexer, metrics

    def work(content: str) -> dict:
        try:
            found = metrics.measured(content, qualify_traits)
        except lexer.Malformed as fault:
            return {"malformed": str(fault)}
        return {"functions": found["functions"], "file_counts": found["file"], "error_facts": [{"fact": a, "name": b} for a, b in found["error_facts"]]}

    return _mapped(files, MEASURED, work)


def production(files: DataFrame) -> DataFrame:
    """Files that are no tests; tested before any file is parsed."""
    return files.where(~is_test_path(F.col("file")))


def once(files: DataFrame) -> DataFrame:
    """Of a file below several overlapping roots, the row of the first root."""
    first = Window.partitionBy("file").orderBy("root_ord")
    return files.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def function_rows(parsed: DataFrame) -> DataFrame:
    """One row for each function, with ord in the order of files and of functions in them."""
    rows = parsed.select("file", F.col("ord").alias("file_ord"), F.posexplode("functions").alias("nth", "f"))
    return rows.select("file", "f.*", (F.shiftleft(F.col("file_ord").cast("long"), 22) + F.col("nth")).alias("ord"))


def file_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("malformed IS NULL").select("file", "ord", "file_counts.*")


def error_rows(parsed: DataFrame) -> DataFrame:
    """(item, missing) of each root's error types; every root sees its whole tree.

    The facts of a file and name are one number, a bit for each kind, so that the three sides come from one
    shuffle of them and the files are parsed once.
    """
    from pawl.operators.observe import error_types

    bits = {"defined": 1, "implemented": 2, "returned": 4}
    facts = parsed.select("root", "file", F.explode("error_facts").alias("x")).select("root", "file", "x.*")
    bit = F.coalesce(*[F.when(F.col("fact") == fact, n) for fact, n in bits.items()])
    seen = facts.repartition("root", "file", "name").groupBy("root", "file", "name").agg(F.bit_or(bit).alias("seen"))
    side = lambda fact: seen.where(F.col("seen").bitwiseAND(F.lit(bits[fact])) > 0)
    return error_types(side("defined").select("root", "file", "name"), side("implemented").select("root", "name"), side("returned").select("root", "name"))


def code_lines(files: DataFrame) -> DataFrame:
    """Adds code_lines, the numbers of the lines that hold code."""
    from pawl.rust import lexer

    schema = T.StructType([T.StructField("code_lines", T.ArrayType(T.LongType()))])
    return _mapped(files, schema, lambda content: {"code_lines": lexer.code_lines(content)})


def contracts(files: DataFrame) -> DataFrame:
    """(kind, id, hash): every test and every scope, see metrics.contracts.

    Scopes that share an id are hashed together. Two tests of one id are an error, as one of them could
    change unseen.
    """
    from pawl.rust import metrics

    schema = T.StructType([T.StructField("contracts", T.ArrayType(CONTRACT))])

    def work(content: str) -> dict:
        # ids begin with the file's name, which is put in front below
        return {"contracts": [{"kind": a, "id": b, "text": c} for a, b, c in metrics.contracts(content, "")]}

    found = _mapped(files, schema, work).select("file", F.explode("contracts").alias("x"))
    rows = found.select("x.kind", F.concat("file", "x.id").alias("id"), "x.text")
    text = F.array_join(F.array_sort(F.collect_list("text")), "\n")
    twice = F.raise_error(F.concat(F.lit("two tests share the name "), F.col("id"))).cast("string")
    return rows.groupBy("kind", "id").agg(F.when((F.col("kind") == "test") & (F.count(F.lit(1)) > 1), twice).otherwise(F.sha2(text, 256)).alias("hash"))


def items(functions: DataFrame, files: DataFrame, errors: DataFrame) -> DataFrame:
    """Long items (metric, key, value, ord) of all source metrics."""
    names = {"cyclomatic": "cyclomatic", "cognitive": "cognitive", "halstead": "halstead_difficulty", "unsafe": "unsafe_count", "panic": "panic_count", "allow": "allow_count"}
    names |= {"bare_panic": "bare_panic_count", "bare_allow": "bare_allow_count", "pub_wrapper": "pub_wrapper_count", "get_prefix": "get_prefix_count"}
    wide = functions.select(function_key(F.col("file"), F.col("name")).alias("key"), "ord", *[F.col(c).cast("double").alias(m) for m, c in names.items()])
    per_function = wide.unpivot(["key", "ord"], list(names), "metric", "value")
    named = {"file_loc": "loc", "file_allow": "allow_count", "file_bare_allow": "bare_allow_count", "deny_warnings": "deny_warnings_count"}
    wide = files.select(F.col("file").alias("key"), F.col("ord").cast("long").alias("ord"), *[F.col(c).cast("double").alias(m) for m, c in named.items()])
    per_file = wide.unpivot(["key", "ord"], list(named), "metric", "value")
    per_type = errors.select(F.col("item").alias("key"), F.xxhash64("item").alias("ord"), F.lit("missing_error_impl").alias("metric"), F.col("missing").cast("double").alias("value"))
    return per_function.unionByName(per_file).unionByName(per_type).select("metric", "key", "value", "ord")

"""Work that grows with the tables: spread over tasks, done once, no more memory in one task."""

import itertools
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from pawl.functions import source
from pawl.plans import catalog
from pawl.rust import lexer, parser
from pawl.sources import lcov, lintlog

ONE = "pub struct Fault;\npub fn f() -> Result<u8, Fault> { Ok(1) }\n"


def counted(spark, folder, rows):
    """Files with error facts, and the number of times that a file was scanned."""
    files = spark.createDataFrame(rows, "root string, file string, content string").coalesce(1)
    note = str(folder / "scans")
    kinds = source.MEASURED["error_facts"].dataType

    def run(batches):
        from pawl.rust import metrics

        for batch in batches:
            texts = batch.column(2).to_pylist()
            with open(note, "a") as f:
                f.write("x" * len(texts))
            facts = [[{"fact": a, "name": b} for a, b in metrics.measured(t)["error_facts"]] for t in texts]
            kind = pa.list_(pa.struct([("fact", pa.string()), ("name", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(facts, kind)], names=["root", "file", "content", "error_facts"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("error_facts", kinds)])), lambda: os.path.getsize(note)


def test_error_types_come_from_one_pass(spark, tmp_path):
    rows = [("r", "a.rs", ONE), ("r", "b.rs", ONE), ("r", "c.rs", "impl std::error::Error for Fault {}"), ("s", "d.rs", ONE), ("s", "e.rs", "struct Unused;")]
    parsed, scans = counted(spark, tmp_path, rows)
    found = {(r.item, r.missing) for r in source.error_rows(parsed).collect()}
    assert found == {("a.rs::Fault", 0), ("b.rs::Fault", 0), ("d.rs::Fault", 1)}
    assert scans() == len(rows)


DEALT = ["error_types_of_files", "file_shapes", "function_shapes", "function_metrics", "file_metrics", "contract_hashes", "halstead_of_files", "code_lines"]


@pytest.mark.parametrize("name", DEALT)
def test_files_of_a_small_table_are_dealt(spark, sf, monkeypatch, name):
    """The table's one block of rows becomes the work of several tasks, none with most of the files."""
    seen = []
    mapped = source._mapped
    monkeypatch.setattr(source, "_mapped", lambda files, *rest: (seen.append(files), mapped(files, *rest))[1])
    catalog.QUERIES[name](spark, sf)
    sizes = seen[0].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == spark.read.parquet(f"{sf}/part.parquet").count()
    assert sum(x > 0 for x in sizes) > 1 and max(sizes) < sum(sizes) / 2


def test_equal_contents_are_worked_on_once():
    done = []
    results = source.each_once(lambda text: done.append(text) or {"n": len(text)}, most=4)
    rows, places = results(pa.array(["aa", None, "aa", "b", ""]))
    assert [rows[k]["n"] for k in places.to_pylist()] == [2, 0, 2, 1, 0] and done == ["aa", "", "b"]
    rows, places = results(pa.array(["b", "long text", "aa", "ccc", "long text", "b"]))
    assert [rows[k]["n"] for k in places.to_pylist()] == [1, 9, 2, 3, 9, 1]
    # what is longer than all that is remembered is not, and remembering too much forgets the rest
    assert done == ["aa", "", "b", "long text", "ccc"]


def test_a_token_is_tried_against_patterns_that_begin_like_it(monkeypatch):
    tried = set()

    class Noted:
        def __init__(self, pattern):
            self.pattern = pattern

        def match(self, text, at):
            tried.add(text[at])
            return self.pattern.match(text, at)

    for name in ("RAW", "QUOTED", "CHAR", "LIFE", "NUMBER"):
        monkeypatch.setattr(lexer, name, Noted(getattr(lexer, name)))
    source = "fn f<'a>(x: &'a u8) -> u8 { /* y */ let z = x.0 + 1 - b'c'; r#\"s\"#; g(z, \"t\") }\n"
    kinds = [t.text for g in lexer.tokenize(source) if g.kind == "group" for t in g.inner if t.kind in ("lit", "life")]
    assert kinds == ["'a", "0", "1", "b'c'", "r#\"s\"#"] and tried <= set("bcr\"'0123456789")


def test_an_operator_is_the_longest_that_starts_there():
    for run in itertools.product("=<>.-:&|+*/!;#", repeat=3):
        at = parser.Parser(lexer.tokenize("".join(run)) if "//" not in "".join(run) and "/*" not in "".join(run) else [])
        if at.tokens:
            assert at.operator() == max((op for op in parser.OPERATORS if "".join(run).startswith(op)), key=len, default="")


def test_contracts_of_equal_files_bear_their_own_names(spark, monkeypatch):
    from pawl.rust import metrics

    monkeypatch.setattr(source, "_mapped", lambda files, schema, work: files.sparkSession.createDataFrame([(r.file, work(r.content)["contracts"]) for r in files.collect()], T.StructType([files.schema["file"], *schema.fields])))
    text = "#[test] fn a() { x(); }\n"
    given = spark.createDataFrame([("x.rs", text), ("y.rs", text), ("z.rs", "fn ("), ("w.rs", "")], "file string, content string")
    wanted = {(k, i, metrics.digest(t)) for r in given.collect() for k, i, t in metrics.contracts(r.content, r.file)}
    assert {tuple(r) for r in source.contracts(given).collect()} == wanted and ("test", "z.rs#unparsed", metrics.digest("fn (")) in wanted
    # what is worked out of a content holds no file's name, so that it serves every file of that content
    monkeypatch.setattr(metrics, "contracts", lambda content, file: [("gate", file, content)])
    assert {r.id for r in source.contracts(given).collect()} == {"x.rs", "y.rs", "z.rs", "w.rs"}


def test_a_trace_of_many_blocks_is_no_work_of_one_task(spark, monkeypatch):
    """Ends are carried as by one pass over each trace, in windows of a few blocks each."""
    rng = random.Random(5)
    rows = []
    for trace in "ab":
        for block in [*range(40), -9, -1, 70, 71, 1 << 20, 1 << 40, (1 << 62) + 5]:
            rows.append((trace, block, rng.choice([None, None, (None,), (f"f{block}",)])))
    wanted, last = {}, {}
    for trace, block, end in sorted(rows, key=lambda r: r[:2]):
        wanted[trace, block] = last.get(trace)
        last[trace] = last.get(trace) if end is None else end
    ends = spark.createDataFrame(rng.sample(rows, len(rows)), "trace string, block long, end struct<file: string>")
    for bits, levels in ((16, 4), (2, 4), (3, 2)):
        monkeypatch.setattr(lcov, "BITS", bits)
        found = lcov.carried(ends, levels)
        assert {(r.trace, r.block): r.carried and tuple(r.carried) for r in found.collect()} == wanted
    lines = spark.createDataFrame([("t", 0, 0, "SF:x"), ("t", 1, 1, "DA:1,1")], "trace string, block long, ord long, line string")
    assert [tuple(r) for r in lcov.line_records(lines).collect()] == [("x", 1, 1)]
    windows = re.findall(r"windowspecdefinition\((.*?) ASC", lcov.with_file(lines, "")._jdf.queryExecution().analyzed().toString())
    assert sum("bucket" in w for w in windows) == 3


@pytest.mark.parametrize(("name", "passes"), [("lint_log_faults", 2), ("lint_log_findings", 1), ("lint_log_stale", 1)])
def test_a_log_line_is_parsed_once_in_a_pass(spark, sf, name, passes):
    """No filter holds a copy of the parse, and a line is written once too."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == passes and plan.count("try_variant_get(") == passes


def test_log_lines_of_a_small_table_are_dealt(spark, sf):
    sizes = catalog._log(spark, sf).select("ord").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert sum(x > 0 for x in sizes) > 1 and max(sizes) < sum(sizes) / 2


def test_faults_of_a_log_come_from_its_end_and_its_packages(spark):
    built = '{"reason": "compiler-artifact", "package_id": "path+file:///%s", "fresh": %s}'
    end = '{"reason": "build-finished", "success": true}'
    members = ["path+file:///a", "path+file:///b", "path+file:///c", "path+file:///b"]

    def faults(lines, members):
        log = spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
        return sorted(tuple(r) for r in lintlog.faults(lintlog.parsed(log), members).collect())

    assert faults([built % ("a", "false"), built % ("b", "true"), end, " "], members) == [("not rebuilt", m) for m in ("path+file:///b", "path+file:///b", "path+file:///c")]
    assert faults([built % ("a", "false"), end], members[:1]) == [] and faults([end], []) == []
    assert faults([end, built % ("d", "false")], []) == [("not finished", "")] == faults([], [])
    assert faults([], members[:2]) == [("not finished", ""), ("not rebuilt", members[0]), ("not rebuilt", members[1])]

"""The commands over a small crate on disk."""

import json
import os

import pytest

from pawl import cli
from pawl.operators import compare, coverage, hints, lints, ratchet, tighten
from pawl.plans import gate, render
from pawl.sources import lcov, lintlog, mutants, policy, snapshot, tree

CODE = """
pub fn tidy(x: u8) -> u8 {
    x
}
pub fn knotty(a: bool, b: bool) -> u8 {
    if a {
        for _ in 0..3 {
            if b {
                return 1;
            }
        }
    }
    x.unwrap()
}
"""
LOG = [
    {"reason": "compiler-message", "package_id": "path+file:///p", "message": {"level": "warning", "message": "m", "code": {"code": "dead_code"}, "spans": [{"file_name": "src/lib.rs", "line_start": 8, "column_start": 1, "is_primary": True}]}},
    {"reason": "compiler-message", "package_id": "path+file:///p", "message": {"level": "warning", "message": "m", "code": None, "spans": []}},
    {"reason": "compiler-artifact", "package_id": "path+file:///p", "fresh": False},
    {"reason": "build-finished", "success": True},
]


@pytest.fixture
def repo(tmp_path):
    os.makedirs(tmp_path / "src" / "tests")
    os.makedirs(tmp_path / "target" / "src")
    (tmp_path / "Cargo.toml").write_text("[package]\n")
    (tmp_path / "src" / "lib.rs").write_text(CODE)
    (tmp_path / "src" / "_odd.rs").write_text("fn odd() {}\n")
    (tmp_path / "src" / "tests" / "t.rs").write_text("fn unseen() {}\n")
    (tmp_path / "target" / "src" / "x.rs").write_text("fn unseen() {}\n")
    lines = "".join(f"DA:{n},{int(n < 6)}\n" for n in range(2, 14))
    (tmp_path / "lcov.info").write_text(f"SF:{tmp_path}/src/lib.rs\n{lines}DA:2,x\nend_of_record\nDA:1,1\n")
    (tmp_path / "lint.json").write_text("\n".join(map(json.dumps, LOG)) + "\nno json\n")
    (tmp_path / "mutants.json").write_text(json.dumps({"total_mutants": 2, "caught": 1, "missed": 1, "timeout": 0, "unviable": 0, "outcomes": [{"summary": "MissedMutant", "scenario": {"Mutant": {"name": "n"}}}, {"summary": "Success", "scenario": "Baseline"}]}))
    return tmp_path


def test_tree(spark, repo):
    assert tree.detect_roots(spark, str(repo)) == ["src"]
    files = tree.rust_files(spark, str(repo), ["src"])
    assert sorted(r.file for r in files.collect()) == ["src/_odd.rs", "src/lib.rs", "src/tests/t.rs"]
    assert {r.file for r in tree.inventory(spark, str(repo)).collect()} == {"Cargo.toml", "src/_odd.rs", "src/lib.rs", "src/tests/t.rs"}
    assert tree.missing_roots(spark, str(repo), ["src", "gone", "../out"]) == ["gone", "../out"]


def test_init_passes_its_own_gate_and_tightens(spark, repo):
    files = dict(trace=str(repo / "lcov.info"), log=str(repo / "lint.json"))
    text = gate.init_text(spark, str(repo), **files)
    rules = policy.parse(text)
    assert rules.baseline["panic"] == {"src/lib.rs::knotty": 1}
    found = gate.read(spark, str(repo), rules, files["trace"], files["log"])
    rows, bad, _ = gate.gate(spark, rules, found)
    assert bad.collect() == []
    assert rows.count() == 20 + len(rules.groups)
    assert all(r.passes_gate for r in rows.collect())
    # a looser baseline is lowered, an entry without an item is removed
    loose = text.replace('"src/lib.rs::knotty" = 1', '"src/lib.rs::knotty" = 5\n"src/lib.rs::gone" = 2', 1)
    tight = policy.parse(gate.tighten_text(spark, loose, found))
    assert tight.baseline == rules.baseline
    kinds = {r.kind for r in gate.gate(spark, policy.parse(loose), found)[1].collect()}
    assert kinds == {"loose", "unmatched"}


def test_gate_without_baseline(spark, repo):
    rules = policy.Policy()
    found = gate.read(spark, str(repo), rules, str(repo / "lcov.info"), str(repo / "lint.json"), str(repo / "mutants.json"))
    rows, bad, advice = gate.gate(spark, rules, found)
    assert {(r.metric, r.key) for r in bad.collect()} == {
        ("bare_panic", "src/lib.rs::knotty"), ("coverage", "@project"), ("dead_code", "dead_code@src/lib.rs::knotty"),
        ("mutants", "@project"), ("panic", "src/lib.rs::knotty"),
    }
    assert {r.metric for r in advice.collect()} == {"bare_panic", "coverage", "dead code", "mutants", "panic"}
    lines = render.table_lines(r.asDict() for r in rows.orderBy("ord").collect())
    assert len(lines) == 28 and "src/lib.rs::knotty" in "\n".join(lines)
    assert json.loads(render.report_json(rows, bad, advice))["passed"] is False


def test_unmeasured_passes(spark, repo):
    rules = policy.Policy(targets=policy.Policy().targets | {"panic": 9, "bare_panic": 9}, baseline={"crap": {"x": 50.0}, "dead_code": {"y": 3}})
    rows, bad, _ = gate.gate(spark, rules, gate.read(spark, str(repo), rules))
    assert bad.collect() == []
    assert {r.metric for r in rows.where("NOT measured").collect()} >= {"coverage", "crap", "mutants", "dead_code"}


def test_snapshots(spark, repo):
    rules, context, checks = policy.Policy(), {"coverage": False, "doctests": False}, {"source": "passed", "clippy": "passed", "tests": "passed", "doctests": "not_applicable"}
    with pytest.raises(ValueError, match="malformed"):
        gate.measure(spark, str(repo), rules, str(repo / "a.json"), context, checks, log=str(repo / "lint.json"))
    (repo / "lint.json").write_text("\n".join(map(json.dumps, LOG)))
    before = gate.measure(spark, str(repo), rules, str(repo / "a.json"), context, checks, log=str(repo / "lint.json"))
    with pytest.raises(FileExistsError):
        gate.measure(spark, str(repo), rules, str(repo / "a.json"), context, checks, log=str(repo / "lint.json"))
    decision, _ = gate.comparison(spark, before, snapshot.load(spark, str(repo / "a.json")))
    assert decision.first()["quality_change"] == "unchanged"
    (repo / "src" / "lib.rs").write_text(CODE.replace("x.unwrap()", "1"))
    after = gate.measure(spark, str(repo), rules, str(repo / "b.json"), context, checks, log=str(repo / "lint.json"))
    decision, changes = gate.comparison(spark, before, after)
    assert decision.first()["quality_change"] == "improved"
    assert {r.id for r in changes.where("outcome = 'improved'").collect()} == {"panic@src/lib.rs::knotty", "bare_panic@src/lib.rs::knotty"}
    decision, _ = gate.comparison(spark, after, before)
    assert decision.first()["quality_change"] == "regressed"
    other = snapshot.sealed(after | {"checks": checks | {"tests": "failed"}, "context": context | {"rustc": "2"}})
    row = gate.comparison(spark, before, other)[0].first()
    assert (row["measurement"], row["quality_change"], len(row["reasons"])) == ("incomparable", "incomparable", 2)
    with pytest.raises(snapshot.BadSnapshot):
        snapshot.validate(after | {"needs_tightening": True})


def test_lcov(spark, repo):
    rows = {(r.line, r.hits) for r in coverage.line_hits(lcov.records(spark, str(repo / "lcov.info"), str(repo))).collect()}
    assert (2, 1) in rows and (13, 0) in rows and len(rows) == 12
    sources = spark.createDataFrame([("src/lib.rs",)], "file string")
    assert {r.fault for r in lcov.faults(spark, str(repo / "lcov.info"), sources, str(repo)).collect()} == {"a line number or hit count is not a number", "a line stands outside records"}
    big = spark.createDataFrame([("f", 1, coverage.MAX_HITS), ("f", 1, 5)], "file string, line long, hits long")
    assert coverage.line_hits(big).first()["hits"] == coverage.MAX_HITS
    spans = spark.createDataFrame([("f", "a", 0, 1, 4, 2), ("f", "b", 1, 9, 9, 3)], "file string, name string, ord long, start_line long, end_line long, cyclomatic int")
    lines = spark.createDataFrame([("f", 1, 1), ("f", 2, 0)], "file string, line long, hits long")
    assert [(r.name, r.crap) for r in coverage.crap_scores(spans, lines).collect()] == [("a", 2.5)]


def test_lint_log(spark, repo):
    log = lintlog.read(spark, str(repo / "lint.json"))
    assert [tuple(r) for r in lintlog.findings(log).collect()] == [("dead_code", "src/lib.rs", 8, 1, "m")]
    assert {r.fault for r in lintlog.faults(log, ["path+file:///p", "path+file:///q"]).collect()} == {"malformed", "not finished", "not rebuilt"}
    (repo / "stale.json").write_text(json.dumps({"reason": "compiler-artifact", "package_id": "path+file:///p", "fresh": True}))
    with pytest.raises(ValueError):
        lintlog.checked_findings(spark, str(repo / "stale.json"))
    spanless = [{"reason": "compiler-message", "message": {"message": None, "code": {"code": "c"}, "spans": [{"file_name": "a", "line_start": 1, "column_start": 1, "is_primary": False}]}}]
    (repo / "s.json").write_text("\n".join(map(json.dumps, spanless)))
    assert [tuple(r) for r in lintlog.checked_findings(spark, str(repo / "s.json")).collect()] == [("c", "<unknown>", 0, 0, "")]


def test_innermost_function_and_groups(spark):
    functions = spark.createDataFrame([("f", "wide", 0, 1, 20), ("f", "one", 1, 5, 8), ("f", "two", 2, 6, 9)], "file string, name string, ord long, start_line long, end_line long")
    found = spark.createDataFrame([("clippy::a_b", "f", 7, 1, "m"), ("clippy::axb", "f", 30, 1, "m")], "code string, file string, line long, column long, message string")
    items = lints.with_item(found, functions)
    assert {r.item for r in items.collect()} == {"clippy::a_b@f::one", "clippy::axb@f#L30"}
    groups = spark.createDataFrame([("z", "clippy::a_*"), ("y", "clippy::a*")], "grp string, pattern string")
    assert {(r.code, r.kind) for r in lints.classify(found, groups).collect()} == {("clippy::a_b", "group:y"), ("clippy::axb", "group:y")}
    assert lints.overlaps(groups).count() == 1


def test_mutants(spark, repo):
    row = mutants.read(spark, str(repo / "mutants.json")).first()
    assert (row["total"], row["missed"], row["missed_examples"]) == (2, 1, ["n"])
    (repo / "bad.json").write_text(json.dumps({"total_mutants": 2, "caught": -1, "missed": 1, "timeout": 0, "unviable": 0, "outcomes": []}))
    with pytest.raises(Exception, match="negative"):
        mutants.read(spark, str(repo / "bad.json")).collect()


@pytest.mark.parametrize(
    "text",
    ["[targets]\ncyclomatic_max = -1", "[targets]\ncrap_max = nan", "[targets]\ncoverage_min_pct = 101.0", "[other]\n", "[targets]\nnope = 1", "[lint_groups.\"a b\"]\nlints = []",
     "[lint_groups.a]\nlints = [\"x*\", \"xy\"]", "[lint_groups.a]\nlints = [\"x*y\"]", "[lint_groups]\n[baseline.lint_groups.a]\nx = 1", "[baseline.halstead]\nx = inf"],
)
def test_bad_policies(text):
    with pytest.raises(policy.BadPolicy):
        policy.parse(text)


def test_policy_defaults_and_text():
    assert len(policy.parse("").groups) == 7 and sum(len(x) for x, _ in policy.parse("").groups.values()) == 23
    assert policy.parse("[lint_groups]\n").groups == {}
    section = render.baseline_toml([("panic", 'a"b\\c', 2.0), ("crap", "k", 3.0), ("lints.g", "i", 1.0)], 50.0)
    back = policy.parse("[lint_groups.g]\nlints = [\"x\"]\n" + section)
    assert (back.baseline, back.group_baseline, back.floor) == ({"panic": {'a"b\\c': 2}, "crap": {"k": 3.0}}, {"g": {"i": 1}}, 50.0)
    assert render.replace_baseline("a = 1\n[baseline]\nx = 1\n", "[baseline]\n") == "a = 1\n[baseline]\n"
    with pytest.raises(ValueError):
        render.replace_baseline("[baseline]\n[targets]\n", "")


def test_ratchet_edges(spark):
    targets = spark.createDataFrame([("m", 10.0, 1), ("h", 10.0, 10)], "metric string, target double, scale long")
    rows = [("m", "dup", 12.0, 0), ("m", "dup", 15.0, 1), ("m", "low", 3.0, 2), ("h", "near", 20.0, 3), ("h", "far", 20.0, 4), ("m", "first", 15.0, 5)]
    items = spark.createDataFrame(rows, "metric string, key string, value double, ord long")
    baseline = spark.createDataFrame([("m", "dup", 15.0), ("m", "low", 11.0), ("m", "gone", 11.0), ("h", "near", 20.1), ("h", "far", 20.2)], "metric string, key string, ceiling double")
    found = {(r.key, r.status) for r in ratchet.baseline_status(items, targets, baseline).collect()}
    assert found == {("dup", "pinned"), ("low", "met"), ("gone", "unmatched"), ("near", "pinned"), ("far", "loose")}
    top = {r.metric: (r.worst_key, r.over_target) for r in ratchet.worst(items, targets).collect()}
    assert top == {"m": ("dup", 3), "h": ("near", 2)}
    floors = spark.createDataFrame([(50.0, 60.0, None), (60.0, 60.0, 50.0), (55.0, 60.0, 54.0), (55.1, 60.0, 54.0), (40.0, 60.0, 50.0)], "percent double, target double, floor double")
    assert [r.status for r in ratchet.coverage_rule(floors).collect()] == ["below_floor", "met", "ok", "loose", "below_floor"]


def test_clamp_outcomes(spark):
    old = spark.createDataFrame([("m", "a", 5), ("m", "b", 5), ("m", "c", 5), ("m", "d", 5), ("u", "x", 1)], "metric string, key string, ceiling long")
    fresh = spark.createDataFrame([("m", "a", 3), ("m", "b", 5), ("m", "c", 9), ("m", "e", 2)], "metric string, key string, ceiling long")
    seen = spark.createDataFrame([("m",)], "metric string")
    clamped = tighten.clamp(old, fresh, seen)
    assert {(r.key, r.outcome, r.ceiling) for r in clamped.collect()} == {("a", "lowered", 3), ("b", "kept", 5), ("c", "raise_refused", 5), ("d", "removed", None), ("e", "refused", None), ("x", "untouched", 1)}
    assert tuple(tighten.summary(clamped).first()) == (1, 1, 2)


def test_compare_truth_table(spark):
    schema = "id string, metric string, entity string, target long, scale long, direction string, value long"
    row = lambda i, v, metric="m", target=5, d="lower": (i, metric, "e", target, 1, d, v)
    before = spark.createDataFrame([row("better", 9), row("same", 3), row("gone", 9), row("lint_gone", 2, "dead_code", 0), row("null_one", None), row("null_both", None), row("contract", 9), row("cover", 4, d="higher")], schema)
    after = spark.createDataFrame([row("better", 7), row("same", 5), row("lint_new", 2, "lints.g", 0), row("null_one", 9), row("null_both", None), row("contract", 9, target=6), row("new", 9), row("new_ok", 5), row("cover", 3, d="higher")], schema)
    found = {r.id: r.outcome for r in compare.compared(before, after).collect()}
    assert found == {"better": "improved", "same": "unchanged", "gone": "disappeared", "lint_gone": "improved", "lint_new": "regressed", "null_one": "availability_changed", "null_both": "ignored", "contract": "contract_changed", "new": "regressed", "new_ok": "unchanged", "cover": "regressed"}


def test_every_metric_has_a_hint():
    assert {"dead code" if m == "dead_code" else "redundant code" if m == "redundant_code" else m for m in policy.METRICS} <= set(hints.HINTS)
    assert {"lints", "baseline"} <= set(hints.HINTS)


METADATA = {"workspace_root": "/w", "workspace_members": ["path+file:///p"], "packages": [{"id": "path+file:///p", "name": "p", "targets": [{"kind": ["lib"]}], "dependencies": [{"name": "q", "path": None}]}]}
LINTS = "Lint checks provided by the compiler:\n    name  default  meaning\n    dead-code  warn  unused\n    missing-docs  allow  docs\n    clippy::unwrap_used  allow  u\n"


def test_measure_is_strict(spark, repo):
    """Cut off or stale logs, misspelt patterns and a changed context end a measurement."""
    (repo / "log.json").write_text("\n".join(map(json.dumps, LOG)))
    (repo / "meta.json").write_text(json.dumps(METADATA))
    (repo / "lints.txt").write_text(LINTS)
    rules = policy.parse('[lint_groups.g]\nlints = ["missing_docs", "clippy::unwrap*"]\n')
    given = dict(log=str(repo / "log.json"), metadata=str(repo / "meta.json"), lint_list=str(repo / "lints.txt"), env={"RUSTFLAGS": "-g", "HOME": str(repo), "OTHER": "x"})
    run = lambda name, rules=rules, **more: gate.measure(spark, str(repo), rules, str(repo / name), {"coverage": False}, {}, **(given | more))
    data = run("ok.json")
    assert data["context"]["enabled_lints"] == ["clippy::unwrap_used", "dead_code", "missing_docs", "renamed_and_removed_lints", "unknown_lints"]
    assert data["context"]["doctests"] is True and set(data["context"]["environment"]) == {"RUSTFLAGS"} and "Cargo.toml" in data["context"]["controls"]
    with pytest.raises(ValueError, match="missing_doc of group g matches no lint"):
        run("a.json", policy.parse('[lint_groups.g]\nlints = ["missing_doc"]\n'))
    with pytest.raises(ValueError, match="the coverage trace"):
        run("a.json", trace=str(repo / "lcov.info"))
    (repo / "cut.json").write_text("\n".join(map(json.dumps, LOG[:3])))
    with pytest.raises(ValueError, match="not finished"):
        run("a.json", log=str(repo / "cut.json"))
    (repo / "other.json").write_text(json.dumps(METADATA).replace("///p", "///q"))
    with pytest.raises(ValueError, match="not rebuilt"):
        run("a.json", metadata=str(repo / "other.json"))
    with pytest.raises(ValueError, match="debt"):
        run("a.json", policy.parse("[baseline]\ncoverage_min_pct = 5.0\n"))
    (repo / "policy.toml").write_text("[targets]\npanic_max = 3\n")
    with pytest.raises(ValueError, match="policy changed"):
        run("a.json", config=str(repo / "policy.toml"))
    changed = snapshot.sealed(data | {"context": data["context"] | {"environment": {}}})
    assert gate.comparison(spark, data, changed)[0].first()["quality_change"] == "incomparable"


def test_trace_in_many_blocks(spark, repo):
    """Sources are carried from one block of a trace to the next."""
    path = str(repo / "long.info")
    with open(path, "w") as f:
        for k in range(300):
            f.write(f"SF:src/f{k}.rs\n" + "".join(f"DA:{n},{n % 3}\n" for n in range(1, 40)) + "end_of_record\n")
    wanted = {(f"src/f{k}.rs", n, n % 3) for k in range(300) for n in range(1, 40)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = lcov.records(spark, path)
        assert lcov.lines_of(spark, path).select("block").distinct().count() > 5
        assert {tuple(r) for r in found.collect()} == wanted
        sources = spark.createDataFrame([(f"src/f{k}.rs",) for k in range(300)], "file string")
        assert lcov.faults(spark, path, sources).collect() == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_commands(spark, repo, capsys):
    call = lambda *argv: cli.run(spark, ["--repo", str(repo), *argv])
    trace, log = str(repo / "lcov.info"), str(repo / "lint.json")
    assert call("init", "--coverage", trace, "--clippy-log", log) == 0
    told = capsys.readouterr().out
    assert "measured 2 files, 3 functions" in told and "max-fn-params-bools = 0" in told
    assert call("init") == 1 and "--force" in capsys.readouterr().err
    given = ["--coverage", trace, "--clippy-log", log]
    report, summary = str(repo / "report.json"), str(repo / "summary.md")
    assert call(*given, "--json", report, "--github-summary", summary) == 0
    assert json.loads(open(report).read())["passed"] is True and "## Quality gate" in open(summary).read()
    config = repo / "pawl.toml"
    config.write_text(config.read_text().replace('"src/lib.rs::knotty" = 1', '"src/lib.rs::knotty" = 5', 1))
    assert call(*given, "--github-summary", summary) == 1
    said = capsys.readouterr().err
    assert "is below its ceiling" in said and "how to fix:" in said and "**How to fix:**" in open(summary).read()
    assert call(*given, "--tighten") == 0 and call(*given) == 0
    capsys.readouterr()
    assert call(*given, "--write-baseline") == 0 and capsys.readouterr().out.startswith("[baseline]")
    with pytest.raises(SystemExit) as end:
        call("--tighten", "--write-baseline")
    assert end.value.code == 2
    assert call("compare", "none.json", "none.json") == 2

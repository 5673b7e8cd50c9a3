"""The commands: gate, fresh baseline, tighten, init, measure and compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawl.functions import source
from pawl.functions.columns import function_key, scaled
from pawl.operators import compare, coverage, hints, lints, ratchet, tighten
from pawl.plans import render
from pawl.sources import lcov, lintlog, mutants, policy, snapshot, tree

KIND_METRICS = {"dead": "dead_code", "redundant": "redundant_code"}


@dataclass
class Measured:
    """What was measured: source always, the reports where they were given."""

    functions: DataFrame
    files: DataFrame
    errors: DataFrame
    lines: DataFrame | None = None
    findings: DataFrame | None = None
    mutants: DataFrame | None = None


def read_source(spark: SparkSession, repo: str, roots: list[str], qualify_traits: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Functions, files and error types below the roots. A file that cannot be parsed is an error."""
    parsed = source.measured(source.production(tree.rust_files(spark, repo, roots)), qualify_traits).cache()
    fault = parsed.where("malformed IS NOT NULL").select("file", "malformed").first()
    if fault:
        raise ValueError(f"{fault['file']}: {fault['malformed']}")
    own = source.once(parsed).withColumn("ord", F.shiftleft(F.col("root_ord").cast("long"), 30) + F.col("ord"))
    return source.function_rows(own), source.file_rows(own), source.error_rows(parsed)


def read(spark: SparkSession, repo: str, rules: policy.Policy, trace: str | None = None, log: str | None = None, mutation: str | None = None, qualify_traits: bool = False) -> Measured:
    functions, files, errors = read_source(spark, repo, rules.roots, qualify_traits)
    return Measured(
        functions,
        files,
        errors,
        coverage.line_hits(lcov.records(spark, trace, repo)) if trace else None,
        lints.classify(lintlog.checked_findings(spark, log, repo), rules.groups_frame(spark)) if log else None,
        mutants.read(spark, mutation) if mutation else None,
    )


def items(found: Measured) -> DataFrame:
    """All per-item measurements (metric, key, value, ord)."""
    rows = source.items(found.functions, found.files, found.errors)
    if found.lines is not None:
        scores = coverage.crap_scores(found.functions, found.lines)
        rows = rows.unionByName(scores.select(F.lit("crap").alias("metric"), function_key(F.col("file"), F.col("name")).alias("key"), F.col("crap").alias("value"), "ord"))
    if found.findings is not None:
        rows = rows.unionByName(lint_items(found))
    return rows


def lint_items(found: Measured) -> DataFrame:
    counted = lints.tally(lints.with_item(found.findings, found.functions))
    metric = F.coalesce(*[F.when(F.col("kind") == k, m) for k, m in KIND_METRICS.items()], F.concat(F.lit("lints."), F.expr("substring(kind, 7)")))
    return counted.select(metric.alias("metric"), F.col("item").alias("key"), F.col("n").cast("double").alias("value"), F.xxhash64("item").alias("ord"))


def measured_metrics(spark: SparkSession, rules: policy.Policy, found: Measured) -> DataFrame:
    """Metrics whose inputs were given; the others are not judged and keep their baseline."""
    finding = {"dead_code", "redundant_code"} | {f"lints.{g}" for g in rules.groups}
    names = [m for m, *_ in rules.target_rows() if m not in finding | {"coverage", "crap", "mutants"}]
    names += ["crap"] if found.lines is not None else []
    names += sorted(finding) if found.findings is not None else []
    return spark.createDataFrame([(n,) for n in names], "metric string")


def coverage_state(spark: SparkSession, rules: policy.Policy, found: Measured) -> DataFrame | None:
    if found.lines is None:
        return None
    total = coverage.totals(found.lines)
    return total.select("percent", F.lit(float(rules.targets["coverage"])).alias("target"), F.lit(rules.floor).cast("double").alias("floor"))


def gate(spark: SparkSession, rules: policy.Policy, found: Measured) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Report rows (with ord), violations and hints."""
    targets, seen = rules.targets_frame(spark), measured_metrics(spark, rules, found)
    per_item = targets.where(~F.col("metric").isin("coverage", "mutants")).select("metric", "target", "scale")
    own = per_item.join(seen, "metric", "left_semi")
    measured, baseline = items(found).cache(), rules.baseline_frame(spark)
    bad = ratchet.violations(measured, own, baseline)
    rows = ratchet.report_rows(measured, per_item, baseline, seen)
    single = lambda metric, value, target, meets, passes, key: (
        F.lit(metric).alias("metric"), target.alias("target"), F.lit(True).alias("measured"), key.alias("worst_key"), value.cast("double").alias("worst_value"),
        F.lit(0).cast("long").alias("over_target"), meets.alias("meets_target"), passes.alias("passes_gate"),
    )
    nothing = F.lit(None).cast("string")
    state = coverage_state(spark, rules, found)
    absent = [m for m, given in (("coverage", state), ("mutants", found.mutants)) if given is None]
    if state is not None:
        judged = ratchet.coverage_rule(state)
        rows = rows.unionByName(judged.select(*single("coverage", F.col("percent"), F.col("target"), F.col("percent") >= F.col("target"), F.col("passes_gate"), nothing)))
        bad = bad.unionByName(judged.where("NOT passes_gate").select(F.lit("coverage").alias("metric"), F.lit("@project").alias("key"), F.col("status").alias("kind"), F.col("percent").alias("value"), "target", F.col("floor").alias("ceiling")))
    if found.mutants is not None:
        most = int(rules.targets["mutants"])
        judged = ratchet.mutants_rule(found.mutants, most)
        rows = rows.unionByName(judged.select(*single("mutants", F.col("missed"), F.lit(float(most)), F.col("passes_gate"), F.col("passes_gate"), nothing)))
        bad = bad.unionByName(judged.where("NOT passes_gate").select(F.lit("mutants").alias("metric"), F.lit("@project").alias("key"), F.lit("new").alias("kind"), F.col("missed").cast("double").alias("value"), F.lit(float(most)).alias("target"), F.lit(None).cast("double").alias("ceiling")))
    for metric in absent:
        row = spark.createDataFrame([(metric, float(rules.targets[metric]), False, None, None, 0, False, True)], rows.schema)
        rows = rows.unionByName(row)
    order = {m: k for k, (m, *_) in enumerate(rules.target_rows())}
    ranked = rows.join(spark.createDataFrame(list(order.items()), "metric string, ord int"), "metric")
    stale = F.col("kind").isin("unmatched", "met", "loose")
    text = F.concat(gate_key(F.col("metric")), F.lit(": "), F.col("key"), F.when(stale, F.lit(" (or run --tighten)")).otherwise(F.lit("")))
    keyed = bad.join(spark.createDataFrame(list(order.items()), "metric string, ord int"), "metric").select("ord", text.alias("text"))
    return ranked, bad, hints.for_violations(keyed)


def gate_key(metric):
    """The gate's spelling of the two finding metrics has a blank."""
    return F.when(metric.isin("dead_code", "redundant_code"), F.replace(metric, F.lit("_"), F.lit(" "))).otherwise(metric)


def fresh_baseline(spark: SparkSession, rules: policy.Policy, found: Measured) -> tuple[DataFrame, float | None]:
    """Ceilings for all that is over its target now, and a floor for coverage."""
    targets = rules.targets_frame(spark).join(measured_metrics(spark, rules, found), "metric", "left_semi")
    state = coverage_state(spark, rules, found)
    floor = tighten.fresh_floor(state.drop("floor")).first()["floor"] if state is not None else None
    return tighten.fresh_baseline(items(found), targets.select("metric", "target", "scale")), floor


def tightened(spark: SparkSession, rules: policy.Policy, found: Measured) -> tuple[DataFrame, float | None, DataFrame]:
    """The clamped baseline, the clamped floor and the summary of both."""
    fresh, floor = fresh_baseline(spark, rules, found)
    clamped = tighten.clamp(rules.baseline_frame(spark), fresh, measured_metrics(spark, rules, found))
    both = tighten.clamp_floor(spark.createDataFrame([(rules.floor, floor)], "old_floor double, fresh_floor double"))
    if found.lines is None:
        return clamped, rules.floor, tighten.summary(clamped)
    return clamped, both.first()["floor"], tighten.summary(clamped.select("outcome").union(both.select("outcome")))


def tighten_text(spark: SparkSession, text: str, found: Measured) -> str:
    """The policy's text with its baseline tightened; it is parsed again before it is given back."""
    clamped, floor, _ = tightened(spark, policy.parse(text), found)
    rows = [(r["metric"], r["key"], r["ceiling"]) for r in clamped.where("ceiling IS NOT NULL").toLocalIterator()]
    out = render.replace_baseline(text, render.baseline_toml(rows, floor))
    policy.parse(out)
    return out


def init_text(spark: SparkSession, repo: str, trace: str | None = None, log: str | None = None, preset: bool = True) -> str:
    """A starter policy that the code passes as it is."""
    return started(spark, repo, trace, log, preset)[0]


def started(spark: SparkSession, repo: str, trace: str | None, log: str | None, preset: bool) -> tuple[str, policy.Policy, Measured]:
    rules = policy.Policy(roots=tree.detect_roots(spark, repo))
    if not rules.roots:
        raise ValueError(f"no src folder beside a Cargo.toml below {repo}")
    if not preset:
        rules.groups = {}
    found = read(spark, repo, rules, trace, log)
    fresh, floor = fresh_baseline(spark, rules, found)
    rows = [(r["metric"], r["key"], r["ceiling"]) for r in fresh.toLocalIterator()]
    out = render.policy_toml(rules.roots, rules.targets, rules.groups, render.baseline_toml(rows, floor))
    policy.parse(out)
    return out, rules, found


def init(spark: SparkSession, repo: str, path: str, trace: str | None = None, log: str | None = None, preset: bool = True, force: bool = False) -> str:
    """Write a starter policy and say what it holds. A policy that is there stays unless force is given."""
    if tree.exists(spark, path) and not force:
        raise FileExistsError(f"{path} exists; give --force to write it anew")
    text, rules, found = started(spark, repo, trace, log, preset)
    snapshot.write(spark, path, text)
    entries = sum("=" in line for line in text[text.index("[baseline]") :].splitlines())
    told = [f"wrote {path}", f"  rust roots: {', '.join(rules.roots)}", f"  measured {found.files.count()} files, {found.functions.count()} functions; {entries} baseline entries"]
    return "\n".join(told) + "\n" + render.setup_notes(rules.groups)


def observations(spark: SparkSession, rules: policy.Policy, found: Measured) -> DataFrame:
    """Fixed-point observations of a snapshot; functions without coverage have null values."""
    targets = rules.targets_frame(spark)
    owner = F.when(F.col("item_kind") == "finding", F.expr("substring(key, locate('@', key) + 1)")).otherwise(F.col("key"))
    place = F.when(owner.contains("#L"), F.substring_index(owner, "#L", 1)).otherwise(owner)
    per_item = source.items(found.functions, found.files, found.errors)
    if found.findings is not None:
        rolled = lints.rolled_up(lints.tally(lints.with_item(found.findings, found.functions)))
        metric = F.coalesce(*[F.when(F.col("kind") == k, m) for k, m in KIND_METRICS.items()], F.concat(F.lit("lints."), F.expr("substring(kind, 7)")))
        per_item = per_item.unionByName(rolled.select(metric.alias("metric"), F.concat("lint", F.lit("@"), "entity").alias("key"), F.col("n").cast("double").alias("value"), F.lit(0).cast("long").alias("ord")))
    key = function_key(F.col("file"), F.col("name")).alias("key")
    crap = found.functions.select(key, F.lit("crap").alias("metric"), "ord")
    if found.lines is not None:
        inside = coverage.production_lines(found.lines, found.functions)
        scores = coverage.crap_scores(found.functions, found.lines).select(key, F.col("crap").alias("value"))
        crap = crap.join(scores, "key", "left")
        percent = coverage.totals(inside).select(F.lit("coverage").alias("metric"), F.lit("@project").alias("key"), F.when(F.col("instrumented") > 0, F.col("percent")).alias("value"), F.lit(0).cast("long").alias("ord"))
    else:
        crap = crap.withColumn("value", F.lit(None).cast("double"))
        percent = spark.createDataFrame([("coverage", "@project", None, 0)], "metric string, key string, value double, ord long")
    everything = per_item.unionByName(crap).unionByName(percent)
    starts = found.functions.select(key, F.col("start_line").alias("line"))
    return (
        everything.join(targets, "metric")
        .join(starts, "key", "left")
        .select(
            F.concat("metric", F.lit("@"), "key").alias("id"), "metric", F.col("key").alias("item"), place.alias("entity"),
            F.when(place == "@project", F.lit("")).otherwise(F.substring_index(place, "::", 1)).alias("file"), "line",
            scaled(F.col("value"), F.col("scale")).alias("value"), scaled(F.col("target"), F.col("scale")).alias("target"), "scale", "direction",
        )
    )


def refuse(faults: DataFrame, what: str, most: int = 5) -> None:
    """An error that names the first faults, if there are any. The limit is what fits a message."""
    found = faults.limit(most).collect()
    if found:
        raise ValueError(f"{what}: " + "; ".join(" ".join(str(x) for x in r.asDict().values() if x != "") for r in found))


def captured(spark: SparkSession, repo: str, inputs: DataFrame, env: dict[str, str] | None) -> dict:
    """What steers a build beside the sources: settings files and variables, as digests."""
    return {
        "controls": {r["file"]: r["hash"] for r in tree.controls(spark, repo, inputs, env).collect()},
        "environment": {r["key"]: r["hash"] for r in tree.environment(spark, env).collect()},
    }


def measure(
    spark: SparkSession,
    repo: str,
    rules: policy.Policy,
    output: str,
    context: dict,
    checks: dict[str, str],
    trace: str | None = None,
    log: str | None = None,
    metadata: str | None = None,
    lint_list: str | None = None,
    env: dict[str, str] | None = None,
    config: str | None = None,
) -> dict:
    """Measure, seal and publish a snapshot. Builds and tests are run by the caller, who gives their
    logs, the versions of tools and features (context), and the outcome of each check.

    Logs are read strictly: a trace or log that is cut off, malformed or stale is an error, and so is
    one that lacks a member of the workspace (metadata: the build tool's JSON). lint_list is the
    compiler's list of lints; every pattern of the policy has to match one of it. Settings files and
    variables of the build go into the context as digests. Inputs, settings and the policy (config: its
    path) are read again at the end; if they changed, nothing is written.
    """
    if tree.exists(spark, output):
        raise FileExistsError(output)
    if not output.endswith(".json"):
        raise ValueError("a snapshot's name ends in .json")
    if missing := tree.missing_roots(spark, repo, rules.roots):
        raise ValueError(f"source roots are missing: {', '.join(missing)}")
    if trace is None and (rules.floor is not None or rules.baseline.get("crap")):
        raise ValueError("the baseline has debt in coverage or crap: give a trace")
    inventory = tree.inventory(spark, repo)
    before = {r.file: r.hash for r in inventory.toLocalIterator()}
    context = context | captured(spark, repo, inventory, env)
    members = []
    if metadata:
        packages = tree.workspace(spark, metadata).collect()
        members = [r["id"] for r in packages]
        context["doctests"] = any(r["has_library"] for r in packages)
    if lint_list:
        known, groups = lintlog.lint_inventory(spark.read.text(lint_list)), rules.groups_frame(spark)
        if wrong := lints.unresolved(groups, known):
            raise ValueError("the policy's lint patterns: " + "; ".join(wrong))
        if empty := [g for g, (patterns, _) in rules.groups.items() if not patterns]:
            raise ValueError(f"lint groups without lints: {', '.join(sorted(empty))}")
        context["enabled_lints"] = sorted(r["code"] for r in lints.enabled(groups, known).collect())
    if trace:
        refuse(lcov.faults(spark, trace, inventory.select("file"), repo).orderBy("ord").select("fault"), "the coverage trace")
    if log:
        refuse(lintlog.faults(lintlog.read(spark, log), members), "the lint log")
    found = read(spark, repo, rules, trace, log, qualify_traits=True)
    if found.files.isEmpty():
        raise ValueError("no production source was measured")
    names = found.functions.groupBy("file", "name").count().where("count > 1").first()
    if names:
        raise ValueError(f"two functions share the name {names['file']}::{names['name']}")
    rows = [r.asDict() for r in observations(spark, rules, found).toLocalIterator()]
    contracts = source.contracts(tree.rust_files(spark, repo, rules.roots)).collect()
    plain = read(spark, repo, rules, trace, log)
    needed = tighten.needs_tightening(tightened(spark, rules, plain)[0]).first()["needed"]
    inventory = tree.inventory(spark, repo)
    after = {r.file: r.hash for r in inventory.toLocalIterator()}
    if before != after:
        raise ValueError("files changed while they were measured")
    if any(context[k] != v for k, v in captured(spark, repo, inventory, env).items()):
        raise ValueError("settings of the build changed while it was measured")
    if config and policy.load(spark, config) != rules:
        raise ValueError("the policy changed while it was measured")
    data = snapshot.sealed(
        {
            "version": snapshot.VERSION,
            "context": context,
            "policy": {"targets": rules.targets, "groups": {g: list(x) for g, x in rules.groups.items()}, "roots": rules.roots, "floor": rules.floor, "baseline": rules.baseline, "group_baseline": rules.group_baseline},
            "inputs": after,
            "test_contracts": {r["id"]: r["hash"] for r in contracts if r["kind"] == "test"},
            "compilation_gates": {r["id"]: r["hash"] for r in contracts if r["kind"] == "gate"},
            "checks": checks,
            "entities": sorted({"@project"} | {f for f in after if f.endswith(".rs")} | {r["entity"] for r in rows}),
            "observations": {r["id"]: {k: v for k, v in r.items() if k != "id"} for r in rows},
            "findings": [r.asDict() for r in found.findings.select(*lints.FINDING).orderBy(*lints.FINDING).toLocalIterator()] if found.findings is not None else [],
            "needs_tightening": bool(needed),
        }
    )
    snapshot.validate(data)
    snapshot.write_new(spark, output, snapshot.canonical(data))
    return data


def comparison(spark: SparkSession, before: dict, after: dict) -> tuple[DataFrame, DataFrame]:
    """The decision (one row) and the changes between two valid snapshots."""
    reasons = []
    if before["context"] != after["context"]:
        reasons.append("tools, features, environment or build settings differ")
    if before["policy"] != after["policy"]:
        reasons.append("targets, lint groups, roots or baseline differ")
    pair = lambda name: (snapshot.pairs(spark, before, name), snapshot.pairs(spark, after, name))
    told = lambda rows, key, text: rows.select(F.concat(F.lit(text), F.col(key)).alias("reason"))
    found = spark.createDataFrame([(r,) for r in reasons], "reason string")
    found = found.union(told(compare.changed_tests(*pair("test_contracts")), "id", "a test changed or is gone: "))
    found = found.union(told(compare.changed_gates(*pair("compilation_gates")), "id", "a condition of compilation changed: "))
    found = found.union(told(compare.removed(snapshot.entities(spark, before), snapshot.entities(spark, after), "entity"), "entity", "no longer there: "))
    found = found.union(told(compare.removed(*pair("inputs"), "file"), "file", "an input is gone: "))
    for side in (before, after):
        failed = compare.failed_checks(snapshot.pairs(spark, side, "checks"), side["context"].get("doctests", False), side["context"].get("coverage", False))
        found = found.union(told(failed, "name", "a required check has no success: "))
    changes = compare.compared(snapshot.observations(spark, before), snapshot.observations(spark, after)).cache()
    return compare.decision(changes, found, after["needs_tightening"]), changes


EXIT = {"improved": 0, "unchanged": 1, "regressed": 1, "incomparable": 2}

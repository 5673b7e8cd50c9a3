"""The commands of the gate: `python -m pawl`, and `measure`, `compare` and `init` below it.

The gate exits with 0 if it passes and 1 if not; compare with 0 (improved), 1 (unchanged or regressed) or
2 (incomparable). Arguments that do not fit together exit with 2, other errors with 1, those of compare
with 2.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from pawl.plans import gate, render
from pawl.sources import policy, snapshot

CONFIG = "pawl.toml"


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pawl", description=__doc__.splitlines()[0])
    parser.add_argument("--repo", default=".", help="the repository (default: the working folder)")
    parser.add_argument("--config", help=f"the policy (default: {CONFIG} in the repository)")
    parser.add_argument("--coverage", help="an lcov trace, for coverage and crap")
    parser.add_argument("--clippy-log", help="the linter's JSON lines, for findings")
    parser.add_argument("--mutants", help="the outcomes of mutation tests")
    parser.add_argument("--json", help="write the report as JSON to this file")
    parser.add_argument("--github-summary", help="append a summary in Markdown to this file")
    either = parser.add_mutually_exclusive_group()
    either.add_argument("--write-baseline", action="store_true", help="print a fresh baseline and do not judge")
    either.add_argument("--tighten", action="store_true", help="rewrite the baseline so that it only shrinks, and do not judge")
    commands = parser.add_subparsers(dest="command")
    init = commands.add_parser("init", help="write a starter policy")
    init.add_argument("--coverage")
    init.add_argument("--clippy-log")
    init.add_argument("--preset", choices=["default", "none"], default="default", help="lint groups to write")
    init.add_argument("--force", action="store_true", help="replace a policy that is there")
    measure = commands.add_parser("measure", help="write a sealed snapshot from the logs of a build")
    measure.add_argument("--output", required=True)
    measure.add_argument("--config")
    measure.add_argument("--coverage")
    measure.add_argument("--clippy-log", required=True)
    measure.add_argument("--metadata", required=True, help="the build tool's description of the workspace, JSON")
    measure.add_argument("--lint-list", required=True, help="the compiler's list of lints")
    measure.add_argument("--context", required=True, help="JSON: versions of tools, features")
    measure.add_argument("--checks", required=True, help="JSON: the outcome of each check")
    compare = commands.add_parser("compare", help="compare two snapshots")
    compare.add_argument("before")
    compare.add_argument("after")
    return parser


def run(spark: SparkSession, argv: Sequence[str]) -> int:
    """The exit code of a command; what it says goes to the standard streams."""
    parser = arguments()
    args = parser.parse_args(argv)
    if args.command and any([args.mutants, args.json, args.github_summary, args.write_baseline, args.tighten]):
        parser.error(f"options of the gate do not go with {args.command}")
    try:
        if args.command == "compare":
            return compared(spark, args)
        config = args.config or f"{args.repo}/{CONFIG}"
        if args.command == "init":
            print(gate.init(spark, args.repo, config, args.coverage, args.clippy_log, args.preset == "default", args.force), end="")
            return 0
        if args.command == "measure":
            return measured(spark, args, config)
        return judged(spark, args, config)
    except (ValueError, OSError, KeyError, PySparkException, Py4JJavaError) as fault:
        print(f"error: {fault}", file=sys.stderr)
        return 2 if args.command == "compare" else 1


def judged(spark: SparkSession, args: argparse.Namespace, config: str) -> int:
    text = spark.read.text(config, wholetext=True).first()[0]
    rules = policy.parse(text)
    found = gate.read(spark, args.repo, rules, args.coverage, args.clippy_log, args.mutants)
    if args.write_baseline:
        fresh, floor = gate.fresh_baseline(spark, rules, found)
        print(render.baseline_toml([(r["metric"], r["key"], r["ceiling"]) for r in fresh.toLocalIterator()], floor), end="")
        return 0
    if args.tighten:
        snapshot.write(spark, config, gate.tighten_text(spark, text, found))
        told = gate.tightened(spark, rules, found)[2].first().asDict()
        print("tightened: " + ", ".join(f"{n} {what}" for what, n in told.items()))
        return 0
    rows, violations, hints = gate.gate(spark, rules, found)
    told = [r.asDict() for r in rows.orderBy("ord").collect()]
    bad = render.violation_lines(r.asDict() for r in violations.orderBy("metric", "key", "kind").toLocalIterator())
    advice = [r.asDict() for r in hints.orderBy("first_ord", "metric").collect()]
    if found.lines is not None:
        print(f"coverage input: {found.lines.count()} instrumented lines\n")
    print("\n".join(render.table_lines(told)))
    if bad:
        print("quality gate violations:", *[f"  - {line}" for line in bad], sep="\n", file=sys.stderr)
        print(render.hints_text(advice), end="", file=sys.stderr)
    if args.json:
        snapshot.write(spark, args.json, render.report_json(rows, violations, hints))
    if args.github_summary:
        render.append_markdown(args.github_summary, render.markdown(told, bad, advice))
    return 0 if all(r["passes_gate"] for r in told) else 1


def measured(spark: SparkSession, args: argparse.Namespace, config: str) -> int:
    given = [json.loads(spark.read.text(path, wholetext=True).first()[0]) for path in (args.context, args.checks)]
    data = gate.measure(
        spark, args.repo, policy.load(spark, config), args.output, given[0] | {"coverage": bool(args.coverage)}, given[1],
        args.coverage, args.clippy_log, args.metadata, args.lint_list, config=config,
    )
    print(render.completion(args.output, len(data["observations"])))
    return 0


def compared(spark: SparkSession, args: argparse.Namespace) -> int:
    decision, changes = gate.comparison(spark, snapshot.load(spark, args.before), snapshot.load(spark, args.after))
    row = decision.first().asDict()
    print(render.comparison_json(row, [c.asDict() for c in changes.where("outcome IN ('improved', 'regressed')").orderBy("id").toLocalIterator()]))
    return gate.EXIT[row["quality_change"]]


def main(argv: Sequence[str] | None = None) -> int:
    given = sys.argv[1:] if argv is None else argv
    arguments().parse_args(given)  # wrong arguments need no session
    spark = SparkSession.builder.appName("pawl").getOrCreate()
    try:
        return run(spark, given)
    finally:
        spark.stop()

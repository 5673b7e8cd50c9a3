"""Reports, baselines and comparisons as text. All of it is small and on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from pawl.sources.policy import FLOATS, LINTER_SETTINGS, METRICS


def report_json(rows: DataFrame, violations: DataFrame, hints: DataFrame) -> str:
    """The whole report as indented JSON."""
    listed = lambda df, *order: [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
    found = listed(violations, "metric", "key", "kind")
    return json.dumps({"passed": not found, "rows": listed(rows, "ord"), "violations": found, "hints": listed(hints, "first_ord", "metric")}, indent=2)


def shown(value: float | None, metric: str) -> str:
    if value is None:
        return "-"
    return f"{value:.2f}%" if metric == "coverage" else f"{value:.1f}" if metric in FLOATS else f"{value:.0f}"


def table_lines(rows: Iterable[Mapping]) -> list[str]:
    """A fixed-width table: metric, value, target, whether each bar is met, and detail."""
    out = [f"{'metric':<24} {'value':>10} {'target':>10} {'target?':<8} {'gate':<5} detail"]
    for r in rows:
        m = r["metric"]
        detail = f"{r['over_target']} over target; worst: {r['worst_key']}" if r["worst_key"] else ("" if r["measured"] else "not measured")
        out.append(f"{m:<24} {shown(r['worst_value'], m):>10} {shown(r['target'], m):>10} {'yes' if r['meets_target'] else 'no':<8} {'ok' if r['passes_gate'] else 'FAIL':<5} {detail}".rstrip())
    return out


def hints_text(hints: Iterable[Mapping]) -> str:
    """The advice for a terminal, nothing without any. hints: metric, hint, in the order to show."""
    lines = [f"  - {h['metric']}: {h['hint']}\n" for h in hints]
    return "".join(["how to fix:\n", *lines]) if lines else ""


def hints_markdown(hints: Iterable[Mapping]) -> str:
    lines = [f"- **{h['metric']}**: {h['hint']}\n" for h in hints]
    return "".join(["\n**How to fix:**\n", *lines]) if lines else ""


def markdown(rows: Iterable[Mapping], violations: Iterable[str], hints: Iterable[Mapping] = ()) -> str:
    out = ["## Quality gate", "", "| metric | value | target | gate |", "|-|-|-|-|"]
    out += [f"| {r['metric']} | {shown(r['worst_value'], r['metric'])} | {shown(r['target'], r['metric'])} | {'ok' if r['passes_gate'] else 'fails'} |" for r in rows]
    listed = [f"- {v}" for v in violations]
    return "\n".join(out + (["", "### Violations", "", *listed] if listed else [])) + "\n" + (hints_markdown(hints) if listed else "")


def violation_lines(violations: Iterable[Mapping]) -> list[str]:
    """Each violation in words."""
    says = {
        "new": "{value} is over the target of {target}",
        "exceeds": "{value} is over its ceiling of {ceiling}",
        "unmatched": "the baseline's entry matches nothing (or run --tighten)",
        "met": "{value} meets the target, the ceiling of {ceiling} is not needed (or run --tighten)",
        "loose": "{value} is below its ceiling of {ceiling} (or run --tighten)",
        "below_floor": "{value} is below the floor of {ceiling}",
    }
    out = []
    for v in violations:
        named = {c: shown(v[c], v["metric"]) for c in ("value", "target", "ceiling")}
        out.append(f"{v['metric']}: {v['key']}: " + says[v["kind"]].format(**named))
    return out


def setup_notes(groups: Mapping[str, tuple[list[str], int]]) -> str:
    """What has to be set up for the lints of the groups to show in a log."""
    if not groups:
        return "  lint groups: none\n"
    lines = [f"  lint groups: {', '.join(groups)}", "most of these lints are off by default; this call reports them:", f"  {lint_command(groups)}", "and these settings belong in clippy.toml beside Cargo.toml:"]
    return "\n".join(lines + [f"  {k} = {v}" for k, v in LINTER_SETTINGS.items()]) + "\n"


def append_markdown(path: str, text: str) -> None:
    """Add to a job summary, a local file that others write to as well."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(text)


def quoted(key: str) -> str:
    return '"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"'


def number(metric: str, value: float) -> str:
    return repr(float(value)) if metric in FLOATS else str(int(value))


def baseline_toml(entries: Iterable[tuple[str, str, float]], floor: float | None = None) -> str:
    """The [baseline] tables, metrics in the catalogue's order, keys sorted, empty ones left out."""
    maps: dict[str, dict[str, float]] = {}
    for metric, key, ceiling in entries:
        maps.setdefault(metric, {})[key] = ceiling
    out = ["[baseline]"] + ([f"coverage_min_pct = {float(floor)!r}"] if floor is not None else [])
    groups = sorted(m for m in maps if m.startswith("lints."))
    for metric in [m for m in METRICS if m in maps] + groups:
        name = "lint_groups." + metric[len("lints.") :] if metric in groups else metric
        out += ["", f"[baseline.{name}]"] + [f"{quoted(k)} = {number(metric, v)}" for k, v in sorted(maps[metric].items())]
    return "\n".join(out) + "\n"


def replace_baseline(text: str, section: str) -> str:
    """The policy's text with its baseline tables, which must come last, replaced by the section."""
    kept, started = [], False
    for line in text.splitlines(keepends=True):
        head = line.lstrip()
        own = head.startswith("[baseline]") or head.startswith("[baseline.")
        if own:
            started = True
        elif started and head.startswith("["):
            raise ValueError(f"{head.strip()} comes after the baseline; move the baseline to the end")
        if not started:
            kept.append(line)
    before = "".join(kept)
    if not started and before:
        before += "\n" if before.endswith("\n") else "\n\n"
    return before + section


def policy_toml(roots: list[str], targets: Mapping[str, float], groups: Mapping[str, tuple[list[str], int]], baseline: str) -> str:
    """A starter policy: targets, roots, lint groups and a fresh baseline."""
    out = ["# Targets say where the code should be; the baseline what it may still be. The baseline only shrinks.", "[targets]"]
    out += [f"{METRICS[m][0]} = {number(m, v)}" for m, v in targets.items()]
    out += ["", "[sources]", "rust_roots = " + json.dumps(roots)]
    for g, (lints, most) in sorted(groups.items()):
        out += ["", f"[lint_groups.{g}]", "lints = " + json.dumps(lints), f"max = {most}"]
    return "\n".join(out) + ("\n\n[lint_groups]" if not groups else "") + "\n\n" + baseline


def lint_command(groups: Mapping[str, tuple[list[str], int]]) -> str:
    """The linter call that reports the lints of the groups."""
    lints = sorted(p for patterns, _ in groups.values() for p in patterns if not p.endswith("*"))
    return "cargo clippy --all-targets --message-format=json -- " + " ".join(f"-W {p}" for p in lints)


def comparison_json(decision: Mapping, changes: Iterable[Mapping]) -> str:
    rows = [dict(c) for c in changes]
    return json.dumps(
        {k: decision[k] for k in ("measurement", "quality_change", "baseline_action", "eligible_to_tighten", "reasons")}
        | {"improvements": [c for c in rows if c["outcome"] == "improved"], "regressions": [c for c in rows if c["outcome"] == "regressed"]},
        indent=2,
    )


def completion(path: str, n_observations: int) -> str:
    return json.dumps({"snapshot": path, "observations": n_observations, "status": "complete"})

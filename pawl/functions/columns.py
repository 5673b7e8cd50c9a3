"""Keys, paths, patterns and fixed-point values as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def function_key(file: Column, name: Column) -> Column:
    """``file::name``, the identity of a function."""
    return F.concat(file, F.lit("::"), name)


def is_test_path(path: Column) -> Column:
    """True inside a tests or benches folder below the root, or for a file of tests."""
    return path.contains("/tests/") | path.contains("/benches/") | path.endswith("/tests.rs") | path.endswith("_tests.rs")


def pattern_matches(pattern: Column, code: Column) -> Column:
    """Equality, or a prefix where the pattern ends in an asterisk. Not LIKE: ``_`` is a letter here."""
    prefix = F.substring(pattern, F.lit(1), F.length(pattern) - F.lit(1))
    return F.when(pattern.endswith("*"), F.startswith(code, prefix)).otherwise(pattern == code)


def patterns_overlap(a: Column, b: Column) -> Column:
    """True if some code matches both patterns."""
    stem = lambda p: F.when(p.endswith("*"), F.substring(p, F.lit(1), F.length(p) - F.lit(1))).otherwise(p)
    both = a.endswith("*") & b.endswith("*")
    return F.when(both, F.startswith(stem(a), stem(b)) | F.startswith(stem(b), stem(a))).when(
        a.endswith("*"), F.startswith(b, stem(a))
    ).when(b.endswith("*"), F.startswith(a, stem(b))).otherwise(a == b)


def repo_relative(path: Column, root: str) -> Column:
    """Slashes forward, the root and one leading ``./`` taken off."""
    slashed = F.translate(path, "\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    inside = F.when(F.startswith(slashed, F.lit(base)), F.substring(slashed, len(base) + 1, 1 << 30)).otherwise(slashed)
    return F.when(F.startswith(inside, F.lit("./")), F.substring(inside, 3, 1 << 30)).otherwise(inside)


def tenths(value: Column) -> Column:
    """Whole tenths, halves away from zero."""
    return F.round(value * 10).cast("long")


def scaled(value: Column, scale: Column | int) -> Column:
    """A fixed-point long; NaN, infinite, negative and overflowing values are errors."""
    raw = F.round(value.cast("double") * scale)
    bad = F.isnan(raw) | (raw < 0) | (raw >= F.lit(2.0**63))
    return F.when(bad, F.raise_error(F.lit("a measurement cannot be stored as a fixed-point number")).cast("long")).otherwise(raw.cast("long"))


def excess(value: Column, target: Column, direction: Column) -> Column:
    """How far a value is beyond its target, 0 if it meets it, null if unmeasured."""
    beyond = F.when(direction == "higher", target - value).otherwise(value - target)
    return F.when(value.isNotNull(), F.greatest(F.lit(0).cast("long"), beyond))


def float_ceiling(value: Column) -> Column:
    """The ceiling that a fresh baseline gives a float: its tenths and one more."""
    return (tenths(value) + 1) / F.lit(10.0)


def coverage_floor(percent: Column) -> Column:
    """The floor that a fresh baseline gives coverage: half a point below, in tenths."""
    return tenths(F.greatest(percent - 0.5, F.lit(0.0))) / F.lit(10.0)


def hint_key(violation: Column) -> Column:
    """The dictionary key of a violation: ``baseline`` for advice to tighten, else its metric."""
    metric = F.substring_index(violation, ": ", 1)
    return (
        F.when(violation.endswith("(or run --tighten)"), F.lit("baseline"))
        .when(F.startswith(metric, F.lit("lints.")), F.lit("lints"))
        .otherwise(metric)
    )


#: Manifests, lock files and settings of tools.
CONTROL_FILES = ["Cargo.toml", "Cargo.lock", "rust-toolchain", "rust-toolchain.toml", "clippy.toml", ".clippy.toml", "build.rs"]


def is_control(path: Column) -> Column:
    """Files that steer a build: manifests, lock files, tool settings and anything in ``.cargo``."""
    name = F.substring_index(path, "/", -1)
    return name.isin(CONTROL_FILES) | F.array_contains(F.split(path, "/"), ".cargo")

"""Source trees: files below roots, manifests, inventories of hashes."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawl.functions.columns import CONTROL_FILES
from pawl.functions.columns import is_control as control_column

BUILD_DIRS = {"target", "node_modules"}
INVENTORY_SKIPS = {".git", "mutants.out", "mutants.out.old", "node_modules", "target"}
ROOT_SKIPS = {"dist", "node_modules", "target", "vendor"}
FILES = "root string, root_ord int, file string, ord long, content string"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _listed(spark: SparkSession, folder: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(path, name, is folder, is link) of a folder, through the file system of Spark."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(conf)
    if not system.exists(path):
        return
    for status in system.listStatus(path):
        whole = status.getPath().toString()
        yield whole, whole.rsplit("/", 1)[-1], status.isDirectory(), status.isSymlink()


def _walk(spark: SparkSession, folder: str, relative: str, skip) -> Iterator[tuple[str, str]]:
    for path, name, is_folder, _ in _listed(spark, folder):
        below = f"{relative}/{name}" if relative else name
        if is_folder:
            if not skip(name):
                yield from _walk(spark, path, below, skip)
        else:
            yield path, below


def _contents(spark: SparkSession, listed: list[tuple]) -> DataFrame:
    """(path, content) read by executors; names that Spark hides are read one by one on the driver."""
    hidden = lambda p: os.path.basename(p)[:1] in "_."
    plain = [p for p, *_ in listed if not hidden(p)]
    frame = spark.createDataFrame([], "path string, content binary")
    if plain:
        frame = frame.union(spark.read.format("binaryFile").load(plain).select("path", "content"))
    rest = []
    for p, *_ in listed:
        if hidden(p):
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(p)
            stream = path.getFileSystem(conf).open(path)
            rest.append((p, bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            stream.close()
    return frame.union(spark.createDataFrame(rest, "path string, content binary")) if rest else frame


def rust_files(spark: SparkSession, repo: str, roots: Sequence[str]) -> DataFrame:
    """Every .rs file below each root (root, root_ord, file, ord, content).

    Folders named target or node_modules or with a dot in front are left out; a root that is missing
    has no files. ord follows the files' paths component by component within their root.
    """
    listed = []
    for number, root in enumerate(roots):
        found = _walk(spark, f"{repo}/{root}", root.strip("/").removeprefix("./"), lambda n: n in BUILD_DIRS or n.startswith("."))
        rust = sorted((p for p in found if p[1].endswith(".rs")), key=lambda p: p[1].split("/"))
        listed += [(path, root, number, file, k) for k, (path, file) in enumerate(rust)]
    if not listed:
        return spark.createDataFrame([], FILES)
    names = spark.createDataFrame(listed, "path string, root string, root_ord int, file string, ord long")
    texts = _contents(spark, list({p[0]: p for p in listed}.values()))
    return names.join(texts, "path").select("root", "root_ord", "file", "ord", F.decode("content", "UTF-8").alias("content"))


def detect_roots(spark: SparkSession, repo: str) -> list[str]:
    """The src folders beside a Cargo.toml that hold Rust files, sorted. A src is not searched for more."""
    found: list[str] = []

    def visit(folder: str, relative: str) -> None:
        entries = list(_listed(spark, folder))
        manifest = any(name == "Cargo.toml" and not is_folder for _, name, is_folder, _ in entries)
        for path, name, is_folder, _ in entries:
            below = f"{relative}/{name}" if relative else name
            if not is_folder or name.startswith(".") or name in ROOT_SKIPS:
                continue
            if name == "src":
                if manifest and any(p.endswith(".rs") for p, _ in _walk(spark, path, "", lambda n: n in BUILD_DIRS or n.startswith("."))):
                    found.append(below)
            else:
                visit(path, below)

    visit(repo, "")
    return sorted(found)


def is_control(path: str) -> bool:
    parts = path.split("/")
    return parts[-1] in CONTROL_FILES or ".cargo" in parts


def inventory(spark: SparkSession, repo: str, skip: Sequence[str] = ()) -> DataFrame:
    """(file, hash) of Rust and control files; a link is an error, as what it shows can change unseen."""
    leave = INVENTORY_SKIPS | set(skip)

    def walk(folder: str, relative: str) -> Iterator[tuple[str, str]]:
        for path, name, is_folder, is_link in _listed(spark, folder):
            if name in leave:
                continue
            below = f"{relative}/{name}" if relative else name
            local = path.removeprefix("file:")
            if is_link or (path.startswith("file:") and os.path.islink(local)):
                raise ValueError(f"a link makes the inventory incomplete: {below}")
            if is_folder:
                yield from walk(path, below)
            elif name.endswith(".rs") or is_control(below):
                yield path, below

    listed = list(walk(repo, ""))
    if not listed:
        return spark.createDataFrame([], "file string, hash string")
    names = spark.createDataFrame(listed, "path string, file string")
    return names.join(_contents(spark, listed), "path").select("file", F.sha2("content", 256).alias("hash"))


def _config_search(repo: str, names: Sequence[str], folder: str = "") -> Iterator[tuple[str, str, str]]:
    """(depth, name, path) of settings in the folders above a local repository."""
    at, depth = os.path.dirname(os.path.abspath(repo)), 0
    while True:
        for name in names:
            path = os.path.join(at, folder, name)
            if os.path.isfile(path):
                yield str(depth), name, path
        if at == os.path.dirname(at):
            return
        at, depth = os.path.dirname(at), depth + 1


def controls(spark: SparkSession, repo: str, inputs: DataFrame, env: dict[str, str] | None = None) -> DataFrame:
    """(file, hash) of all that steers a build: control files of the inventory, settings of the folders
    above, of the user's home, and lint settings that a search from the repository would find."""
    env = dict(os.environ) if env is None else env
    rows = []
    hashed = lambda path: hashlib.sha256(open(path, "rb").read()).hexdigest()  # noqa: E731, SIM115
    for depth, name, path in _config_search(repo, ["config", "config.toml"], ".cargo"):
        rows.append((f"@above/{depth}/{name}", hashed(path)))
    home = env.get("CARGO_HOME") or (os.path.join(env["HOME"], ".cargo") if env.get("HOME") else None)
    for name in ["config", "config.toml"] if home else []:
        if os.path.isfile(path := os.path.join(home, name)):
            rows.append((f"@home/{name}", hashed(path)))
    for depth, name, path in _config_search(repo, ["clippy.toml", ".clippy.toml"]):
        rows.append((f"@lint/{depth}/{name}", hashed(path)))
    named = env.get("CLIPPY_CONF_DIR")
    for name in ["clippy.toml", ".clippy.toml"] if named else []:
        if os.path.isfile(path := os.path.join(named, name)):
            rows.append((f"@lint/named/{name}", hashed(path)))
    own = inputs.where(control_column(F.col("file")))
    return own.union(spark.createDataFrame(rows, "file string, hash string"))


def environment(spark: SparkSession, env: dict[str, str] | None = None) -> DataFrame:
    """(key, hash) of the variables that a build reads; values are never kept as they are."""
    env = dict(os.environ) if env is None else env
    named = {"AR", "CC", "CFLAGS", "CLIPPY_CONF_DIR", "CXX", "CXXFLAGS"}
    rows = [(k, hashlib.sha256(v.encode("utf-8", "surrogateescape")).hexdigest()) for k, v in sorted(env.items()) if k.startswith(("RUST", "CARGO")) or k in named]
    return spark.createDataFrame(rows, "key string, hash string")


def missing_roots(spark: SparkSession, repo: str, roots: Sequence[str]) -> list[str]:
    """Roots that are no folders inside the repository."""
    if not roots:
        raise ValueError("no source roots are configured")
    inside = lambda r: not os.path.isabs(r) and not os.path.normpath(r).startswith("..")
    parents = {r: {n for _, n, d, _ in _listed(spark, os.path.dirname(f"{repo}/{r.rstrip('/')}")) if d} for r in roots if inside(r)}
    return [r for r in roots if r not in parents or os.path.basename(r.rstrip("/")) not in parents[r]]


def workspace(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, has_library) of a workspace's members, from the JSON of a build tool's metadata.

    A member's dependency by path that lies outside the workspace's root is an error.
    """
    kinds = "array<struct<kind: array<string>>>"
    schema = f"workspace_root string, workspace_members array<string>, packages array<struct<id: string, name: string, targets: {kinds}, dependencies: array<struct<name: string, path: string>>>>"
    data = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("m"))
    rows = data.select("m.workspace_root", "m.workspace_members", F.explode("m.packages").alias("p")).where("array_contains(workspace_members, p.id)")
    outside = F.exists("p.dependencies", lambda d: d["path"].isNotNull() & (d["path"] != F.col("workspace_root")) & ~F.startswith(d["path"], F.concat("workspace_root", F.lit("/"))))
    library = F.exists("p.targets", lambda t: F.exists(t["kind"], lambda k: k.isin("lib", "proc-macro", "rlib")))
    guard = F.when(F.coalesce(outside, F.lit(False)), F.raise_error(F.lit("a path dependency lies outside the workspace")).cast("string")).otherwise(F.col("p.id"))
    return rows.select(guard.alias("id"), "p.name", F.coalesce(library, F.lit(False)).alias("has_library"))

"""Sealed snapshots of a measurement as one JSON document each."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

VERSION = 1
OBSERVATION = "id string, metric string, item string, entity string, file string, line long, value long, target long, scale long, direction string"
FIELDS = ["version", "context", "policy", "inputs", "test_contracts", "compilation_gates", "checks", "entities", "observations", "findings", "needs_tightening", "seal"]
MAPS = {"inputs": "file string, hash string", "test_contracts": "id string, hash string", "compilation_gates": "id string, hash string", "checks": "name string, status string"}


class BadSnapshot(ValueError):
    """A snapshot that breaks its own rules."""


def canonical(data: dict) -> str:
    return json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sealed(data: dict) -> dict:
    """With the SHA-256 of its canonical JSON, the seal itself left empty."""
    blank = data | {"seal": ""}
    return blank | {"seal": hashlib.sha256(canonical(blank).encode()).hexdigest()}


def validate(data: dict) -> None:
    if sorted(data) != sorted(FIELDS):
        raise BadSnapshot("fields are missing or unknown")
    if data["version"] != VERSION:
        raise BadSnapshot(f"version {data['version']} is not known")
    if sealed(data)["seal"] != data["seal"]:
        raise BadSnapshot("the seal does not fit the content")
    if not data["observations"] or not data["entities"]:
        raise BadSnapshot("nothing is measured")
    known = set(data["entities"])
    for key, o in data["observations"].items():
        if key != f"{o['metric']}@{o['item']}" or o["scale"] not in (1, 10, 100) or o["direction"] not in ("lower", "higher"):
            raise BadSnapshot(f"observation {key} breaks its rules")
        if o["entity"] not in known:
            raise BadSnapshot(f"observation {key} belongs to nothing known")


def load(spark: SparkSession, path: str) -> dict:
    data = json.loads(spark.read.text(path, wholetext=True).first()[0])
    validate(data)
    return data


def observations(spark: SparkSession, data: dict) -> DataFrame:
    rows = [(k, o["metric"], o["item"], o["entity"], o["file"], o["line"], o["value"], o["target"], o["scale"], o["direction"]) for k, o in sorted(data["observations"].items())]
    return spark.createDataFrame(rows, OBSERVATION)


def pairs(spark: SparkSession, data: dict, name: str) -> DataFrame:
    """One of the maps of a snapshot as a table."""
    return spark.createDataFrame(sorted(data[name].items()), MAPS[name])


def entities(spark: SparkSession, data: dict) -> DataFrame:
    return spark.createDataFrame([(e,) for e in sorted(data["entities"])], "entity string")


def _file_system(spark: SparkSession, path: str):
    """The path and its file system; a local one without checksum files, which later edits would break."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return place, system.getRaw() if system.getScheme() == "file" else system


def write(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """Write a whole file; an exclusive create decides who writes one that must not exist yet."""
    target, system = _file_system(spark, path)
    stream = system.create(target, overwrite)
    stream.write(bytearray(text.encode()))
    stream.hflush()
    stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that must not exist yet: whole under a name of its own, then renamed.

    The rename refuses a file that has come up meanwhile.
    """
    target, system = _file_system(spark, path)
    part_path = f"{path}.{uuid.uuid4().hex}.part"
    part, _ = _file_system(spark, part_path)
    if system.exists(target):
        raise FileExistsError(path)
    write(spark, part_path, text, overwrite=False)
    try:
        if not system.rename(part, target):
            raise FileExistsError(path)
    except Py4JJavaError as fault:
        raise FileExistsError(path) from fault
    finally:
        if system.exists(part):
            system.delete(part, False)

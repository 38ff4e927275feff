"""A chain of frozen steps: each manifest names what its step chose, the hashes of what it read and of the manifest before.

Manifests are written once. Whoever goes on (to the evaluation rows, above all) presents the choice again;
an altered choice, an altered manifest anywhere before it, or a touched file stops the step.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import _file_system
from .serving import canonical_hash


class Frozen(ValueError):
    """What was frozen is not what is there."""


def _write_once(spark: SparkSession, path: str, text: str) -> None:
    fs, found = _file_system(spark, path)
    if fs.exists(found):
        raise Frozen(f"{path} is frozen already")
    out = fs.create(found, False)  # no overwriting, even where two writers race
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def manifests(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(step, text) of the chain in `folder`, the first step first."""
    fs, found = _file_system(spark, folder)
    if not fs.exists(found):
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(found) if x.getPath().getName().endswith(".json"))
    rows = {r.name: r.value for r in spark.read.option("wholetext", True).text([f"{folder}/{n}" for n in names]).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name")).collect()} if names else {}  # a handful of small files
    return [(n.removesuffix(".json").partition("-")[2], rows[n]) for n in names]


def verified(spark: SparkSession, folder: str) -> list[dict]:
    """The manifests of a chain whose every link holds."""
    before, out = "", []
    for step, text in manifests(spark, folder):
        try:
            own = json.loads(text)
        except ValueError as e:
            raise Frozen(f"the manifest of {step} cannot be read") from e
        if own.get("step") != step or own.get("before") != before or own.get("choice_hash") != canonical_hash(own.get("choice")):
            raise Frozen(f"the manifest of {step} does not fit the chain")
        before = hashlib.sha256(text.encode()).hexdigest()
        out.append(own)
    return out


def freeze(spark: SparkSession, folder: str, step: str, choice, inputs: dict[str, str] | None = None) -> dict:
    """Add a step to the chain: its choice (JSON without NaN) and the hashes of its inputs. A step is frozen once."""
    chain = verified(spark, folder)
    if any(x["step"] == step for x in chain):
        raise Frozen(f"{step} is frozen already")
    last = manifests(spark, folder)
    before = hashlib.sha256(last[-1][1].encode()).hexdigest() if last else ""
    own = {"step": step, "choice": choice, "choice_hash": canonical_hash(choice), "inputs": inputs or {}, "before": before}
    _write_once(spark, f"{folder}/{len(chain):04d}-{step}.json", json.dumps(own, sort_keys=True, allow_nan=False))
    return own


def demanded(spark: SparkSession, folder: str, step: str, choice, inputs: dict[str, str] | None = None) -> dict:
    """The manifest of a step, if the chain holds and the step chose this from these inputs."""
    for own in verified(spark, folder):
        if own["step"] == step:
            if own["choice_hash"] != canonical_hash(choice):
                raise Frozen(f"another choice than {step} froze")
            if wrong := [k for k, v in (inputs or {}).items() if own["inputs"].get(k) != v]:
                raise Frozen(f"{step} froze other inputs: {', '.join(sorted(wrong))}")
            return own
    raise Frozen(f"{step} is not frozen")


def opened(rows: DataFrame, where: Column, folder: str, step: str, choice, inputs: dict[str, str] | None = None) -> DataFrame:
    """The rows that may only be read after a step has frozen its choice (the evaluation partition)."""
    demanded(rows.sparkSession, folder, step, choice, inputs)
    return rows.where(where)


def choice_of(rows: DataFrame, most: int = 64) -> list[dict]:
    """A small table of choices as JSON values, in an order of its own; numbers as the text that reads back equal."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no choice")
    plain = lambda v: v.hex() if isinstance(v, float) else v if v is None or isinstance(v, (bool, int, str)) else str(v)
    return sorted(({k: plain(v) for k, v in r.asDict().items()} for r in found), key=canonical_hash)


def snapshot(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, length, sha256 of all files below the paths, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) of two snapshots; `before` must have been written before anything ran."""
    b = before.select("path", F.col("sha256").alias("_was"))
    both = after.select("path", F.col("sha256").alias("_is")).join(b, "path", "full")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("_was").eqNullSafe(F.col("_is"))).select("path", change.alias("change"))


def unharmed(before: DataFrame, spark: SparkSession, paths: Sequence[str]) -> None:
    """An error that names the protected files that were touched since the snapshot."""
    if wrong := touched(before, snapshot(spark, paths)).limit(20).collect():
        raise Frozen("protected files were touched: " + ", ".join(f"{r.path} {r.change}" for r in wrong))

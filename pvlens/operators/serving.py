"""A frozen detector: scaler, forest and threshold in one object, kept as tables with a manifest of hashes; scoring and replay."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite, status
from . import iforest, scores
from .events import group_alert_events
from .gates import demand

FEED = ("Timestamp", "Power_Generated", "Solar_Radiation", "anomaly_score", "threshold", "threshold_margin", "status")


def canonical_hash(value) -> str:
    """SHA-256 of a value's JSON with sorted keys and no blanks; NaN is an error."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def run_id(value) -> str:
    return canonical_hash(value)[:12]


@dataclass(frozen=True)
class Detector:
    features: tuple[str, ...]
    scaler: dict[str, tuple[float, float]]
    forest: pd.DataFrame
    psi: int
    threshold: float

    def hashes(self) -> dict[str, str]:
        trees = [[int(r.tree), int(r.node), int(r.feature), float(r.threshold).hex(), int(r.left), int(r.right), float(r.path).hex()] for r in self.forest.sort_values(["tree", "node"]).itertuples()]
        scaler = {c: [float(m).hex(), float(s).hex()] for c, (m, s) in self.scaler.items()}
        return {"features": canonical_hash(list(self.features)), "scaler": canonical_hash(scaler), "forest": canonical_hash([self.psi, trees]), "threshold": canonical_hash(float(self.threshold).hex())}


def fit_detector(training: DataFrame, features: Sequence[str], key: str, threshold: float = 0.5, **options) -> Detector:
    """Scaler and forest of the training rows; rows with a missing feature are an error."""
    demand(training, {f"not_finite_{c}": ~finite(F.col(c).cast("double")) for c in features})
    scaler = scores.scaler_values(scores.fit_scaler(training, features))
    forest = iforest.fit(scores.scaled(training.select(key, *features), scaler), features, key, **options)
    return Detector(tuple(features), scaler, forest, forest.attrs["psi"], threshold)


def save_detector(spark: SparkSession, detector: Detector, folder: str) -> None:
    """folder/scaler, folder/forest and folder/manifest, written by Spark; a folder that exists is an error."""
    spark.createDataFrame([(i, c, *detector.scaler[c]) for i, c in enumerate(detector.features)], "place int, feature string, mean double, std double").coalesce(1).write.parquet(f"{folder}/scaler")
    spark.createDataFrame(detector.forest, iforest.TREES).coalesce(1).write.parquet(f"{folder}/forest")
    manifest = json.dumps({"psi": detector.psi, "threshold": detector.threshold, "hashes": detector.hashes()}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{folder}/manifest")


def load_detector(spark: SparkSession, folder: str) -> Detector:
    """The detector of a folder; any part whose hash is not the manifest's is an error."""
    manifest = json.loads(spark.read.option("wholetext", True).text(f"{folder}/manifest").first().value)
    rows = spark.read.parquet(f"{folder}/scaler").orderBy("place").collect()  # one row a feature
    forest = spark.read.parquet(f"{folder}/forest").toPandas().sort_values(["tree", "node"])  # at most trees * 2 * sample rows
    forest.attrs["psi"] = manifest["psi"]
    found = Detector(tuple(r.feature for r in rows), {r.feature: (r["mean"], r["std"]) for r in rows}, forest, manifest["psi"], manifest["threshold"])
    if wrong := [k for k, v in found.hashes().items() if manifest["hashes"].get(k) != v]:
        raise ValueError(f"the detector differs from its manifest: {', '.join(wrong)}")
    return found


def score_frame(df: DataFrame, detector: Detector, context: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """context..., anomaly_score, threshold, threshold_margin, status of every row; an empty table keeps this schema.

    strict: a feature that is null or not finite is an error; else such rows have no score and no status.
    """
    missing = [c for c in (*detector.features, *context) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    bad = {f"not_finite_{c}": ~finite(F.col(c).cast("double")) for c in detector.features}
    if strict:
        demand(df, bad)
    names = [f"_feature_{i}" for i in range(len(detector.features))]
    parts = [((F.col(c).cast("double") - F.lit(detector.scaler[c][0])) / F.lit(detector.scaler[c][1])).alias(n) for c, n in zip(detector.features, names)]
    forest = detector.forest.copy()
    forest.attrs["psi"] = detector.psi
    out = iforest.score(df.select(*context, *parts), forest, names)
    s, t = F.col("anomaly_score"), F.lit(float(detector.threshold))
    return out.select(*context, "anomaly_score", t.alias("threshold"), (s - t).alias("threshold_margin"), status(s, t).alias("status"))


def score_observation(spark: SparkSession, observation: dict[str, float], detector: Detector) -> dict:
    """One row's score, threshold, margin and status."""
    row = [float(observation[c]) if observation.get(c) is not None else None for c in detector.features]
    schema = ", ".join(f"`{c}` double" for c in detector.features)
    return score_frame(spark.createDataFrame([tuple(row)], schema), detector).first().asDict()


def feed(df: DataFrame, detector: Detector, columns: Sequence[str] = FEED, by: Sequence[str] = ()) -> DataFrame:
    """The columns of the replay feed, scored."""
    own = [c for c in (*by, *columns) if c not in ("anomaly_score", "threshold", "threshold_margin", "status")]
    return score_frame(df, detector, own).select(*by, *columns)


def clamp_index(index: Column, rows: Column) -> Column:
    return F.greatest(F.lit(0), F.least(index, rows - 1))


def move_index(index: Column, step: Column, rows: Column) -> Column:
    """previous (-1), next (1) or any step, inside the recording."""
    return clamp_index(index + step, rows)


def row_at(df: DataFrame, index: int, pos: str = "_pos") -> DataFrame:
    """The row at a place of the recording; an index beyond its ends is clamped."""
    last = df.agg(F.max(pos).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(F.col(pos) == F.greatest(F.lit(0), F.least(F.lit(index), F.col("_last")))).drop("_last")  # one row


def dashboard_summary(scored: DataFrame, ts: str = "Timestamp", by: tuple[str, ...] = (), gap_seconds: float = 120) -> DataFrame:
    """One row: rows, alerts, share, events, first and last timestamp, highest score."""
    alert = F.col("status") == "ALERT"
    facts = scored.agg(F.count("*").alias("rows"), F.count_if(alert).alias("alerts"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.max("anomaly_score").alias("highest"))
    runs = group_alert_events(scored, ts, by=by, gap_seconds=gap_seconds).agg(F.count("*").alias("events"))
    return facts.crossJoin(F.broadcast(runs)).withColumn("alert_percentage", F.coalesce(F.try_divide(F.col("alerts") * 100.0, "rows"), F.lit(0.0)))  # one row each


def safe_name(name: Column) -> Column:
    """Characters other than letters, digits, dot, underscore and hyphen become underscores."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def upload_problem(name: Column, size: Column, suffixes: Sequence[str], most: int) -> Column:
    """Why an upload is refused; null if it is not."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(size <= 0, "empty").when(size > most, "too_large").when(~suffix.isin(*suffixes), "suffix")


def metric_text(value: float | None, unit: str, digits: int = 2) -> str:
    return "n/a" if value is None or value != value else re.sub(r"\s+$", "", f"{value:,.{digits}f} {unit}")

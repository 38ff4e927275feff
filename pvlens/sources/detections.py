"""What a detector found in videos, as three outputs: rows of detections, a record a frame, a summary a video."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite
from ..operators.vision import video_summary
from .publish import remove, rename
from .reports import write_csv, write_json

VERSION = 1


def detection_rows(log: DataFrame, by: str = "video") -> DataFrame:
    """by, frame_index, video_time, number (from 1 in its frame) and the fields of each detection; `log` as from `vision.frame_log`."""
    each = log.select(by, "frame_index", "video_time", F.posexplode("detections").alias("_at", "_found"))
    return each.select(by, "frame_index", "video_time", (F.col("_at") + 1).alias("number"), "_found.*")


def frame_records(log: DataFrame, by: str = "video") -> DataFrame:
    """by, frame_index, video_time, analysed, n_detections, detections: every frame, skipped ones too.

    Numbers that are NaN or infinite become null, since strict JSON has none; null detections are an empty list.
    """
    fields = log.schema["detections"].dataType.elementType.fields
    number = lambda f: isinstance(f.dataType, (T.DoubleType, T.FloatType))
    clean = lambda d: F.struct(*((F.when(finite(d[f.name]), d[f.name]) if number(f) else d[f.name]).alias(f.name) for f in fields))
    found = F.coalesce(F.transform("detections", clean), F.array().cast(T.ArrayType(T.StructType(fields))))
    return log.select(by, "frame_index", "video_time", "analysed", F.size(found).alias("n_detections"), found.alias("detections"))


def summary_records(log: DataFrame, classes: Sequence[str], stride: int, fps: float, by: str = "video", clean: str = "clean") -> DataFrame:
    """One record a video: version, frames, analysed, stride, fps, duration_seconds, condition, total_detections, and maps by class.

    A class that was not found has 0 and, as its highest confidence, null, as has one whose highest is NaN or infinite. A rate that is not positive counts as 30.
    """
    fps = float(fps if fps > 0 else 30)
    facts = video_summary(log, classes, by, clean)
    total = log.groupBy(F.col(by).alias("_by")).agg(F.sum(F.coalesce(F.size("detections"), F.lit(0))).alias("total_detections"))
    by_class = lambda name: F.map_from_arrays(F.array(*(F.lit(c) for c in classes)), F.array(*(F.col(f"{name}_{c}") for c in classes)))
    return facts.join(total, F.col(by).eqNullSafe(F.col("_by"))).select(
        F.lit(VERSION).alias("version"), by, "frames", "analysed", F.lit(stride).alias("stride"), F.lit(fps).alias("fps"), (F.col("frames") / F.lit(fps)).alias("duration_seconds"), "condition", "total_detections",
        by_class("n").alias("detections_by_class"), by_class("frames").alias("frames_by_class"), F.transform_values(by_class("max"), lambda _, x: F.when(finite(x), x)).alias("highest_by_class"),
    )


def write_results(log: DataFrame, folder: str, classes: Sequence[str], stride: int, fps: float, by: str = "video", clean: str = "clean") -> None:
    """`folder`/detections (CSV), /frames and /summary (JSON lines), in order of video and frame; the three appear together.

    `log` is read once for each output, so pass a written table. A folder that exists, and a log without
    frames, are errors; an output that fails leaves nothing.
    """
    spark = log.sparkSession
    staged = f"{folder.rstrip('/')}.writing-{uuid.uuid4().hex}"
    ordered = lambda df: df.repartitionByRange(by, "frame_index").sortWithinPartitions(by, "frame_index")
    try:
        if log.isEmpty():
            raise ValueError("no frame to write")
        rows = detection_rows(log, by)
        write_csv(rows.repartitionByRange(by, "frame_index").sortWithinPartitions(by, "frame_index", "number"), f"{staged}/detections")
        write_json(ordered(frame_records(log, by)), f"{staged}/frames")
        write_json(summary_records(log, classes, stride, fps, by, clean), f"{staged}/summary")
        rename(spark, staged, folder)
    except Exception:
        remove(spark, staged)
        raise

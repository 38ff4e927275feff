"""Replay of recorded telemetry as a stream, and alert events kept in state.

A session window joins rows up to a gap apart; events here need rows exactly one cadence apart,
so runs are kept by key in state and leave when the next alert does not continue them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import status
from ..functions.windows import micros

EVENT = "series string, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, row_count long, maximum_anomaly_score double"


def read_replay(spark: SparkSession, path: str, schema: str | T.StructType, files_per_step: int = 1) -> DataFrame:
    """A folder of Parquet files, a few a step, in the order of their arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(path)


def with_status(stream: DataFrame, threshold: float, score: str = "anomaly_score") -> DataFrame:
    return stream.withColumn("status", status(F.col(score), threshold))


def alert_runs(stream: DataFrame, series: str = "series", ts: str = "Timestamp", score: str = "anomaly_score", gap_seconds: int = 120) -> DataFrame:
    """Finished runs of ALERT rows of each series, in append mode.

    Rows of a series come in order over the steps; within a step they are sorted here. A run is
    emitted when a later row of its series ends it, be it an alert or not; the run still open at
    the end of the replay stays in state. Every row of a series is read by one task a step.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts")
        open_run, done = (list(state.get) if state.exists else None), []
        for at, value, alert in zip(rows["ts"], rows["score"], rows["alert"]):
            micros = int(at.value // 1000) if hasattr(at, "value") else int(at)
            if open_run and not (alert and micros - open_run[1] == gap_seconds * 1_000_000):
                done.append((key[0], *open_run))
                open_run = None
            if alert:
                open_run = [open_run[0], micros, open_run[2] + 1, max(open_run[3], float(value))] if open_run else [micros, micros, 1, float(value)]
        if open_run:
            state.update(tuple(open_run))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(
            {
                "series": pd.Series([x[0] for x in done], dtype="object"), "start_timestamp": pd.to_datetime([x[1] for x in done], unit="us"), "end_timestamp": pd.to_datetime([x[2] for x in done], unit="us"),
                "row_count": pd.Series([x[3] for x in done], dtype="int64"), "maximum_anomaly_score": pd.Series([x[4] for x in done], dtype="float64"),
            }
        )

    rows = stream.select(F.col(series).cast("string").alias("series"), micros(F.col(ts)).alias("ts"), F.col(score).cast("double").alias("score"), (F.col("status") == "ALERT").alias("alert")).where("ts is not null")
    return rows.groupBy("series").applyInPandasWithState(step, EVENT, "start long, end long, n long, top double", "append", GroupStateTimeout.NoTimeout)

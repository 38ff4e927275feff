"""Event-time windows over a replayed stream: tumbling, sliding and session windows under a watermark, and alert events of an exact cadence.

Rows may come out of order by up to the watermark's delay. A window is given out once, when the
watermark has passed its end; `close_replay` ends a replay by one marker row far ahead, whose own
window stays open, so the last windows come out too. Naive timestamps are used throughout.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import micros, naive

#: Where a replay keeps its state: on disk, so that open windows need not fit in memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """stream with _at, the instant that has a naive time's number of microseconds, under a watermark: a zone has no part in it."""
    return stream.withColumn("_at", F.timestamp_micros(micros(F.col(ts)))).withWatermark("_at", delay)


def _bounds(held: DataFrame, by: Sequence[str]) -> DataFrame:
    bound = lambda side: naive(F.unix_micros(F.col(f"_window.{side}"))).alias(side)
    return held.select(*by, bound("start"), bound("end"), *(c for c in held.columns if c not in (*by, "_window")))


def windowed(stream: DataFrame, ts: str, delay: str, width: str, slide: str | None = None, by: Sequence[str] = (), aggregates: Sequence[Column] = ()) -> DataFrame:
    """by..., start, end and the aggregates of tumbling (or, with slide, sliding) windows; rows later than `delay` are dropped by Spark."""
    return _bounds(in_event_time(stream, ts, delay).groupBy(*by, F.window("_at", width, slide).alias("_window")).agg(*aggregates), by)


def sessions(stream: DataFrame, ts: str, delay: str, gap: str, by: Sequence[str], aggregates: Sequence[Column] = ()) -> DataFrame:
    """by..., start, end and the aggregates of runs whose rows are less than `gap` apart; end is the last row's time plus the gap."""
    return _bounds(in_event_time(stream, ts, delay).groupBy(*by, F.session_window("_at", gap).alias("_window")).agg(*aggregates), by)


def alert_events(stream: DataFrame, delay: str, series: str = "series", ts: str = "Timestamp", score: str = "anomaly_score", gap_seconds: int = 120) -> DataFrame:
    """Runs of ALERT rows exactly `gap_seconds` apart, of each series, whatever the order within the delay: append mode.

    What `group_alert_events` finds with exact=True, where a series has no time twice. Rows whose times leave the same
    remainder by the gap are whole gaps apart, so within a remainder a session of less than two gaps is an exact run,
    which Spark merges from rows in any order. All rows move the watermark, alerts or not: the filter reads the event
    time, so that Spark leaves it behind the watermark.
    """
    gap = int(gap_seconds * 1_000_000)
    rows = in_event_time(stream, ts, delay).where(F.when(F.col("_at").isNotNull(), F.col("status") == "ALERT"))
    rows = rows.select(F.col(series).cast("string").alias("series"), "_at", F.unix_micros("_at").alias("_us"), F.col(score).cast("double").alias("_score"))
    runs = rows.groupBy("series", F.pmod("_us", F.lit(gap)).alias("_phase"), F.session_window("_at", f"{gap * 3 // 2} microseconds").alias("_window"))
    facts = runs.agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count("*").alias("row_count"), F.max("_score").alias("maximum_anomaly_score"), F.avg("_score").alias("mean_anomaly_score"))
    return facts.select("series", naive(F.col("_first")).alias("start_timestamp"), naive(F.col("_last")).alias("end_timestamp"), "row_count", "maximum_anomaly_score", "mean_anomaly_score")


def close_replay(spark: SparkSession, folder: str, ts: str = "Timestamp", after: dt.timedelta = dt.timedelta(days=400)) -> None:
    """One more file in a replay folder: a row of nulls whose time lies `after` the last."""
    held = spark.read.parquet(folder)
    last = held.agg(F.max(ts)).first()[0]
    if last is not None:
        end = F.lit(str(last + after)).cast("timestamp_ntz")
        row = spark.range(1).select(*((end if c == ts else F.lit(None)).cast(t).alias(c) for c, t in held.dtypes))
        row.coalesce(1).write.mode("append").parquet(folder)


def run_out(found: DataFrame, out: str, checkpoint: str, seconds: float | None = None) -> DataFrame:
    """Process all that is there, append it to `out` as Parquet, and read it. State is kept in `STATE_STORE`; `seconds` is a limit, if given."""
    spark = found.sparkSession
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if seconds is None:
            query.awaitTermination()
        elif not query.awaitTermination(seconds):
            query.stop()
            raise TimeoutError(f"the replay did not end within {seconds} seconds")
    finally:
        spark.conf.set(STATE_STORE[0], before)
    return spark.read.schema(found.schema).parquet(out)

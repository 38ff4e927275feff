"""Queries that replay telemetry made from `events` as a stream, out of order, and their SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.windows import micros
from ..sources.folders import working_folder
from ..streaming import replay, windows
from .catalogue import query
from .telemetry import SQL14, START, telemetry

#: Steps of a replay; rows come up to LATE rows (two minutes each) late.
STEPS, LATE = 3, 12


def _replayed(spark, d, make):
    t = telemetry(spark, d).select("series", "n", S.TIMESTAMP, F.col("Power_Generated").alias("anomaly_score"), F.when(F.col("Power_Generated") > 12, "ALERT").otherwise("NORMAL").alias("status"))
    folder, placed = working_folder(spark, "replay"), working_folder(spark, "replay-placed")
    t.write.parquet(placed)  # rows are numbered once, not for every step
    t = spark.read.schema(t.schema).parquet(placed)
    longest = t.agg(F.max("n")).first()[0] or 0
    step = F.least(F.floor((F.col("n") + F.pmod(F.hash("series", "n"), F.lit(LATE))) * STEPS / F.lit(longest + 1)), F.lit(STEPS - 1))
    for k in range(STEPS):
        t.where(step == k).write.mode("append").parquet(folder)
    windows.close_replay(spark, folder)
    stream = replay.read_replay(spark, folder, t.schema, files_per_step=64)
    return windows.run_out(make(stream), working_folder(spark, "replayed"), working_folder(spark, "replay-state"))


@query(f"""WITH a AS (SELECT CAST(series AS VARCHAR) AS series, n, Power_Generated AS x FROM ({SQL14}) WHERE Power_Generated > 12), r AS (SELECT *, n - row_number() OVER (PARTITION BY series ORDER BY n) AS run FROM a)
SELECT series, min(n) AS first_row, max(n) AS last_row, count(*) AS row_count, round(max(x), 5) AS top, round(avg(x), 5) AS mean FROM r GROUP BY series, run""")
def replayed_alert_events(spark, d):
    """Events found by state and timers from rows out of order: those of the whole table in order."""
    found = _replayed(spark, d, lambda s: windows.alert_events(s, f"{2 * LATE + 60} minutes"))
    row = lambda c: ((micros(F.col(c)) - micros(F.lit(START).cast("timestamp_ntz"))) / 120_000_000).cast("long")
    return found.select("series", row("start_timestamp").alias("first_row"), row("end_timestamp").alias("last_row"), "row_count", F.round("maximum_anomaly_score", 5).alias("top"), F.round("mean_anomaly_score", 5).alias("mean"))


@query(f"""SELECT series, CAST(floor((n * 2 - k * 30) / 60) * 60 + k * 30 AS BIGINT) AS start_minute, count(*) AS n, count(CASE WHEN Power_Generated > 12 THEN 1 END) AS alerts, round(max(Power_Generated), 5) AS top FROM ({SQL14}), (SELECT unnest([0, 1]) AS k) GROUP BY ALL""")
def replayed_sliding_windows(spark, d):
    """Windows of an hour every half hour, under a watermark."""
    facts = [F.count("anomaly_score").alias("n"), F.count_if(F.col("status") == "ALERT").alias("alerts"), F.max("anomaly_score").alias("top")]
    found = _replayed(spark, d, lambda s: windows.windowed(s, S.TIMESTAMP, f"{2 * LATE + 60} minutes", "60 minutes", "30 minutes", ["series"], facts))
    minute = ((micros(F.col("start")) - micros(F.lit(START).cast("timestamp_ntz"))) / 60_000_000).cast("long")
    return found.select("series", minute.alias("start_minute"), "n", "alerts", F.round("top", 5).alias("top"))

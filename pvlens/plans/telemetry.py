"""A telemetry table made from `events`, for queries that run the library's own stages, and its SQL.

Each user is a series of rows two minutes apart; the measurements are plain functions of the event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import features as stages

#: Measurement: (Spark and DuckDB read this SQL alike), over event_id as b and value as v.
MEASURES = {
    "Air_Temp": "CAST(20 AS DOUBLE) + CAST(b % 17 AS DOUBLE) * CAST(0.5 AS DOUBLE)",
    "Relative_Humidity": "CAST(40 + b % 41 AS DOUBLE)",
    "Wind_Speed": "CAST(b % 13 AS DOUBLE) * CAST(0.25 AS DOUBLE)",
    "Wind_Direction": "CAST((b * 7) % 380 - 5 AS DOUBLE)",
    "Solar_Radiation": "v * CAST(2 AS DOUBLE) - CAST(60 AS DOUBLE)",
    **{f"RTD_{i}": f"CAST(25 AS DOUBLE) + v / CAST(61 AS DOUBLE) + CAST((b * {i}) % 11 AS DOUBLE) * CAST(0.1171 AS DOUBLE)" for i in range(1, 6)},
    "Array_Voltage": "CAST(30 AS DOUBLE) + CAST(b % 23 AS DOUBLE) * CAST(0.25 AS DOUBLE)",
    "Array_Current": "v / CAST(127 AS DOUBLE)",
    "Power_Generated": "(CAST(30 AS DOUBLE) + CAST(b % 23 AS DOUBLE) * CAST(0.25 AS DOUBLE)) * (v / CAST(127 AS DOUBLE)) + CAST(b % 5 AS DOUBLE) * CAST(0.0613 AS DOUBLE)",
}
START = "2022-04-27 00:00:00"

SQL14 = f"""SELECT series, n, b AS event_id, TIMESTAMP '{START}' + n * INTERVAL 2 MINUTE AS "Timestamp", {", ".join(f"{e} AS {c}" for c, e in MEASURES.items())}
FROM (SELECT user_id AS series, event_id AS b, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events WHERE user_id IS NOT NULL)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, n, event_id and the 14 columns."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    rows = e.select(F.col("user_id").alias("series"), F.col("event_id").alias("b"), F.col("value").alias("v"), (F.row_number().over(w) - 1).cast("long").alias("n"))
    ts = F.expr(f"timestamp_ntz'{START}' + make_dt_interval(0, 0, int(2 * n), 0)")
    return rows.select("series", "n", F.col("b").alias("event_id"), ts.alias(S.TIMESTAMP), *(F.expr(e).alias(c) for c, e in MEASURES.items()))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.features(telemetry(spark, sf_dir), "series")


def _rtd(agg: str) -> str:
    return f"list_{agg}([{', '.join(S.RTDS)}])"


_OF_DAY = '(hour("Timestamp") * 60 + minute("Timestamp"))'
BASIC_SQL = {
    "hour": 'CAST(hour("Timestamp") AS BIGINT)', "minute": 'CAST(minute("Timestamp") AS BIGINT)', "minute_of_day": f"CAST({_OF_DAY} AS BIGINT)",
    "elapsed_minutes_from_start": """(epoch_us("Timestamp") - min(epoch_us("Timestamp")) OVER (PARTITION BY series)) / 6e7""",
    "hour_sin": 'sin(2 * pi() * hour("Timestamp") / 24)', "hour_cos": 'cos(2 * pi() * hour("Timestamp") / 24)', "minute_of_day_sin": f"sin(2 * pi() * {_OF_DAY} / 1440)", "minute_of_day_cos": f"cos(2 * pi() * {_OF_DAY} / 1440)",
    "rtd_mean": _rtd("avg"), "rtd_std": _rtd("stddev_pop"), "rtd_min": _rtd("min"), "rtd_max": _rtd("max"), "rtd_range": f"{_rtd('max')} - {_rtd('min')}",
    "electrical_power_product": "Array_Voltage * Array_Current", "power_consistency_residual": "Power_Generated - Array_Voltage * Array_Current", "power_consistency_abs_error": "abs(Power_Generated - Array_Voltage * Array_Current)",
    "low_light_context": "CAST(CASE WHEN Solar_Radiation <= 5 THEN 1 ELSE 0 END AS BIGINT)",
}
_AGG = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}


def _trailing(column: str, stat: str, rows: int) -> str:
    w = f"OVER (PARTITION BY series ORDER BY n ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {w} = {rows} THEN {_AGG[stat]}({column}) {w} END"


ROLLING_SQL = {f"{c.lower()}_roll_{s}_{label}": _trailing(c, s, n) for c, s, n, label in S.ROLLING_SPECS}


def _before(c: str) -> str:
    return f"lag({c}) OVER (PARTITION BY series ORDER BY n)"


CHANGE_SQL = {f"{c.lower()}_diff": f"{c} - {_before(c)}" for c in S.DIFFERENCED} | {f"{c.lower()}_rate_per_min": f"({c} - {_before(c)}) / 2" for c in S.DIFFERENCED}
CHANGE_SQL |= {f"{c.lower()}_relative_change": f"CASE WHEN abs({_before(c)}) >= {floor} THEN ({c} - {_before(c)}) / {_before(c)} END" for c, floor in (("Power_Generated", 1.0), ("Solar_Radiation", 5.0))}
CHANGE_SQL |= {f"{n}_deviation_from_30m_mean": f"{c} - {c.lower()}_roll_mean_30m" for n, c in (("power", "Power_Generated"), ("solar", "Solar_Radiation"))}
CHANGE_SQL |= {f"{n}_deviation_ratio_30m": f"CASE WHEN abs({c.lower()}_roll_mean_30m) >= {floor} THEN ({c} - {c.lower()}_roll_mean_30m) / {c.lower()}_roll_mean_30m END" for n, c, floor in (("power", "Power_Generated", 1.0), ("solar", "Solar_Radiation", 5.0))}


def _stage(given: str, new: dict[str, str]) -> str:
    return f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in new.items())} FROM ({given})"


def sql81(given: str) -> str:
    """All 81 columns from the SQL of the 14."""
    return _stage(_stage(_stage(given, BASIC_SQL), ROLLING_SQL), CHANGE_SQL)


SQL31 = _stage(SQL14, BASIC_SQL)
SQL61 = _stage(SQL31, ROLLING_SQL)
SQL81 = sql81(SQL14)

#: Shares of the time of the longest series that the partitions take, by row number.
PARTS = (("training", 0, 23), ("calibration", 24, 47), ("evaluation", 48, None))
PART_SQL = "CASE WHEN n <= 23 THEN 'training' WHEN n <= 47 THEN 'calibration' ELSE 'evaluation' END"

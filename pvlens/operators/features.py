"""Causal features of the telemetry table in three stages: 14 -> 31 -> 61 -> 81 columns.

All stages are one logical plan over one window order, so Spark shuffles and sorts once. A
`series` column keeps sites apart, and is what the windows are dealt by. Without it the table is one
series: its rows are numbered in blocks of time and the windows run in chunks that carry the
29 rows before them along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .. import schema as S
from ..functions.ordering import in_chunks, positions, with_group
from ..functions.scalars import column_stats, cyclic, safe_ratio, safe_relative_change
from ..functions.windows import micros, trailing

LOW_LIGHT = 5.0


def _stage(df: DataFrame, series: str | None, back: int, step: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """step(rows, window) by series, or in chunks of one series."""
    if series:
        return step(df, Window.partitionBy(series).orderBy(S.TIMESTAMP))
    columns = df.columns
    if "_pos" not in columns:
        df = positions(df, S.TIMESTAMP)
    out = in_chunks(df, back, 0, lambda rows, part: step(rows, Window.partitionBy(*part).orderBy("_pos")))
    return out if "_pos" in columns else out.drop("_pos")


def add_basic(df: DataFrame, series: str | None = None) -> DataFrame:
    S.require_columns(df, S.S14)
    ts = F.col(S.TIMESTAMP)
    hour, minute = F.hour(ts), F.minute(ts)
    of_day = hour * 60 + minute
    at = micros(ts)
    rtd = {f"rtd_{k}": c for k, c in column_stats(S.RTDS).items()}
    df = df.withColumns(rtd)
    if series:  # in the windows' own order, so the rows are not read and joined again for it
        df = df.withColumn("_start", F.min(at).over(Window.partitionBy(series).orderBy(S.TIMESTAMP).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        df = with_group(df, df.agg(F.min(at).alias("_start")), [])
    start = F.col("_start")
    hs, hc = cyclic(hour, 24)
    ms, mc = cyclic(of_day, 1440)
    product = F.col("Array_Voltage") * F.col("Array_Current")
    residual = F.col("Power_Generated") - product
    return df.select(
        *(c for c in df.columns if c != "_start" and c not in rtd), hour.cast("short").alias("hour"), minute.cast("short").alias("minute"), of_day.cast("short").alias("minute_of_day"), ((at - start) / 6e7).alias("elapsed_minutes_from_start"),
        hs.alias("hour_sin"), hc.alias("hour_cos"), ms.alias("minute_of_day_sin"), mc.alias("minute_of_day_cos"),
        *rtd,
        product.alias("electrical_power_product"), residual.alias("power_consistency_residual"), F.abs(residual).alias("power_consistency_abs_error"),
        F.coalesce((F.col("Solar_Radiation") <= LOW_LIGHT).cast("byte"), F.lit(0).cast("byte")).alias("low_light_context"),
    )


def add_rolling(df: DataFrame, series: str | None = None) -> DataFrame:
    S.require_columns(df, S.S31)
    wanted = [(f"{c.lower()}_roll_{s}_{label}", c, s, n) for c, s, n, label in S.ROLLING_SPECS]
    return _stage(df, series, max(S.WIDTHS.values()) - 1, lambda rows, w: trailing(rows, wanted, w))


def add_change(df: DataFrame, series: str | None = None, minutes: float = 2.0, power_floor: float = 1.0, solar_floor: float = 5.0) -> DataFrame:
    S.require_columns(df, S.S61)
    pairs = (("power", "Power_Generated", power_floor), ("solar", "Solar_Radiation", solar_floor))
    base = {c: F.col(f"{c.lower()}_roll_mean_30m") for _, c, _ in pairs}

    def step(rows: DataFrame, w: WindowSpec) -> DataFrame:
        diff = {c: F.col(c) - F.lag(c).over(w) for c in S.DIFFERENCED}
        return rows.select(
            "*", *(diff[c].alias(f"{c.lower()}_diff") for c in S.DIFFERENCED), *((diff[c] / minutes).alias(f"{c.lower()}_rate_per_min") for c in S.DIFFERENCED),
            *(safe_relative_change(F.col(c), F.lag(c).over(w), f).alias(f"{c.lower()}_relative_change") for _, c, f in pairs),
            *((F.col(c) - base[c]).alias(f"{n}_deviation_from_30m_mean") for n, c, _ in pairs),
            *(safe_ratio(F.col(c) - base[c], base[c], f).alias(f"{n}_deviation_ratio_30m") for n, c, f in pairs),
        )

    return _stage(df, series, 1, step)


def features(df: DataFrame, series: str | None = None) -> DataFrame:
    if series:
        return df.transform(add_basic, series).transform(add_rolling, series).transform(add_change, series)
    placed = positions(df, S.TIMESTAMP)  # numbered once for both stages
    return placed.transform(add_basic).transform(add_rolling).transform(add_change).drop("_pos")

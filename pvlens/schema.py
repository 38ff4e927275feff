"""Pinned layouts of the telemetry tables and the gate that enforces them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

TIMESTAMP = "Timestamp"
RTDS = [f"RTD_{i}" for i in range(1, 6)]
#: Column names and their order.
MEASUREMENTS = ["Air_Temp", "Relative_Humidity", "Wind_Speed", "Wind_Direction", "Solar_Radiation", *RTDS, "Array_Voltage", "Array_Current", "Power_Generated"]
S14 = [TIMESTAMP, *MEASUREMENTS]
BASIC = ["hour", "minute", "minute_of_day", "elapsed_minutes_from_start", "hour_sin", "hour_cos", "minute_of_day_sin", "minute_of_day_cos", "rtd_mean", "rtd_std", "rtd_min", "rtd_max", "rtd_range", "electrical_power_product", "power_consistency_residual", "power_consistency_abs_error", "low_light_context"]
S31 = [*S14, *BASIC]
#: (source column, statistic, rows, label of the width); rows are two minutes apart.
WIDTHS = {"10m": 5, "30m": 15, "60m": 30}
ROLLING_SPECS = (
    [(c, s, WIDTHS[w], w) for c in ("Power_Generated", "Solar_Radiation") for w in WIDTHS for s in ("mean", "std", "min", "max")]
    + [(c, "mean", WIDTHS[w], w) for c in ("Air_Temp", "Relative_Humidity") for w in ("30m", "60m")]
    + [("rtd_mean", s, WIDTHS["30m"], "30m") for s in ("mean", "std")]
)
ROLLING = [f"{c.lower()}_roll_{s}_{w}" for c, s, _, w in ROLLING_SPECS]
S61 = [*S31, *ROLLING]
DIFFERENCED = ["Power_Generated", "Solar_Radiation", "Air_Temp", "Relative_Humidity", "Array_Voltage", "Array_Current", "rtd_mean"]
CHANGE = [
    *(f"{c.lower()}_diff" for c in DIFFERENCED), *(f"{c.lower()}_rate_per_min" for c in DIFFERENCED),
    "power_generated_relative_change", "solar_radiation_relative_change", "power_deviation_from_30m_mean", "solar_deviation_from_30m_mean", "power_deviation_ratio_30m", "solar_deviation_ratio_30m",
]
S81 = [*S61, *CHANGE]


def require_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def assert_layout(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Exact names and order."""
    if list(df.columns) != list(wanted):
        raise ValueError(f"layout differs: got {df.columns}, want {list(wanted)}")
    return df

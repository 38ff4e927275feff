"""Contracts of the stages: each gate is one aggregation whose counts must all be 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import in_chunks, positions
from ..functions.scalars import finite, status
from ..functions.windows import seconds_between


def demand(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df, if no check counts a row; the message of the error lists the counts."""
    row = df.agg(*(F.count_if(c).alias(k) for k, c in checks.items())).first().asDict()
    if wrong := {k: n for k, n in row.items() if n}:
        raise ValueError("contract broken: " + ", ".join(f"{k} in {n} rows" for k, n in wrong.items()))
    return df


def timestamp_gate(df: DataFrame, ts: str = "Timestamp", by: tuple[str, ...] = (), pos: str | None = None, cadence: float | None = None) -> DataFrame:
    """Present, unique, in order of `pos` if given, and evenly spaced if a cadence is given."""
    steps = lambda rows, w: rows.select("*", seconds_between(F.col(ts), F.lag(ts).over(w)).alias("_step"))
    if by:
        seen = steps(df.select(*by, ts, *[pos] * (pos is not None)), Window.partitionBy(*by).orderBy(pos or ts))
    else:  # one series, in chunks
        placed = positions(df.select(ts, *[pos] * (pos is not None)), pos or ts, name="_place")
        seen = in_chunks(placed, 1, 0, lambda rows, part: steps(rows, Window.partitionBy(*part).orderBy("_place")), pos="_place")
    seen = seen.select(F.col(ts).isNull().alias("_null"), "_step")
    checks = {"missing_timestamp": F.col("_null"), "repeated_timestamp": F.col("_step") == 0, "backward_timestamp": F.col("_step") < 0}
    if cadence is not None:
        checks["uneven_timestamp"] = F.col("_step") != cadence
    demand(seen, checks)
    return df


def numeric_gate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return demand(df, {f"not_finite_{c}": ~finite(F.col(c).cast("double")) for c in columns})


def labels_gate(df: DataFrame) -> DataFrame:
    """Binary labels, known contexts, and propagated rows unlabelled."""
    label, context = F.col("synthetic_anomaly"), F.col("effect_context")
    return demand(df, {
        "label_not_binary": ~F.coalesce(label.isin(0, 1), F.lit(False)),
        "unknown_context": ~F.coalesce(context.isin("none", "direct", "propagated"), F.lit(False)),
        "labelled_propagation": (context == "propagated") & (label != 0),
    })


def feed_gate(df: DataFrame, score: str = "anomaly_score", threshold: str = "threshold", margin: str = "threshold_margin", tolerance: float = 1e-12) -> DataFrame:
    """The status follows the strict rule and the margin is score minus threshold."""
    s, t = F.col(score), F.col(threshold)
    return demand(df, {"status_differs": ~F.col("status").eqNullSafe(status(s, t)), "margin_differs": ~F.coalesce(F.abs(s - t - F.col(margin)) <= tolerance, F.lit(False))})


def paired(left: DataFrame, right: DataFrame, key: str = "Timestamp") -> DataFrame:
    """left joined 1:1 to right's other columns (suffix _baseline); unmatched rows on either side are an error."""
    other = right.select(F.col(key).alias("_key"), *(F.col(c).alias(f"{c}_baseline") for c in right.columns if c != key))
    joined = left.join(other, F.col(key).eqNullSafe(F.col("_key")), "full")
    demand(joined, {"unmatched": F.col(key).isNull() | F.col("_key").isNull()})
    return joined.drop("_key")

"""Alert events: gaps and islands over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import numbered_runs, positions
from ..functions.windows import micros, seconds_between


def group_alert_events(scored: DataFrame, ts: str = "Timestamp", score: str = "anomaly_score", status: str = "status", by: tuple[str, ...] = (), gap_seconds: float = 120, exact: bool = True) -> DataFrame:
    """Runs of ALERT rows: event_id, start, end, row_count, duration_minutes, maximum and mean score.

    exact: rows belong together only if exactly `gap_seconds` apart; else up to that gap. No
    alert gives no rows. A duration counts both ends: (end - start) + gap, in minutes.
    """
    alerts = scored.where(F.col(status) == "ALERT")
    joins = lambda gap: (gap == gap_seconds) if exact else (gap <= gap_seconds)
    if by:  # series by series
        w = Window.partitionBy(*by).orderBy(ts)
        starts = F.when(joins(seconds_between(F.col(ts), F.lag(ts).over(w))), 0).otherwise(1)
        runs = alerts.withColumn("_run", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:  # one series, in blocks of time
        placed = positions(alerts.select(ts, score), ts)
        runs = numbered_runs(placed, lambda previous: ~joins(seconds_between(F.col(ts), previous(F.col(ts)))))
    found = runs.groupBy(*by, "_run").agg(
        F.min(ts).alias("start_timestamp"), F.max(ts).alias("end_timestamp"), F.count("*").alias("row_count"), F.max(score).alias("maximum_anomaly_score"), F.avg(score).alias("mean_anomaly_score")
    )
    minutes = ((seconds_between(F.col("end_timestamp"), F.col("start_timestamp")) + gap_seconds) / 60).cast("long")
    name = F.format_string("alert-%03d", F.col("_run"))
    return found.select(name.alias("event_id"), *by, "start_timestamp", "end_timestamp", "row_count", minutes.alias("duration_minutes"), "maximum_anomaly_score", "mean_anomaly_score")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: the four counts and the rates; a rate without cases is 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return counts.select("*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(fp, fp + tn).alias("false_positive_rate"), rate(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def classify_alert_events(scored: DataFrame, runs: DataFrame, ts: str = "Timestamp", status: str = "status", context: str = "effect_context", label: str = "synthetic_anomaly_id", by: tuple[str, ...] = ()) -> DataFrame:
    """runs with the contexts of their alert rows, the direct events they meet and a class.

    direct_overlap: a row of a direct event is among them; propagated_only; unaffected_only; mixed.
    """
    inside = (F.col("_ts") >= F.col("start_timestamp")) & (F.col("_ts") <= F.col("end_timestamp"))
    for c in by:
        inside = inside & F.col(f"_by_{c}").eqNullSafe(F.col(c))
    rows = scored.where(F.col(status) == "ALERT").select(F.col(ts).alias("_ts"), F.col(context).alias("_context"), F.col(label).alias("_label"), *(F.col(c).alias(f"_by_{c}") for c in by))
    # Runs do not overlap: a row meets its run through the hour that both lie in.
    hour = lambda c: F.floor(micros(c) / F.lit(3_600_000_000))
    spread = runs.select("event_id", *by, "start_timestamp", "end_timestamp", F.explode(F.sequence(hour(F.col("start_timestamp")), hour(F.col("end_timestamp")))).alias("_hour"))
    met = spread.join(rows.withColumn("_at", hour(F.col("_ts"))), (F.col("_hour") == F.col("_at")) & inside)
    seen = met.groupBy("event_id", *by).agg(F.sort_array(F.collect_set("_context")).alias("effect_contexts"), F.sort_array(F.collect_set("_label")).alias("direct_event_ids"))
    has = lambda x: F.array_contains("effect_contexts", x)
    alone = F.size("effect_contexts") == 1
    kind = F.when(has("direct"), "direct_overlap").when(alone & has("propagated"), "propagated_only").when(alone & has("none"), "unaffected_only").otherwise("mixed")
    return runs.join(seen, ["event_id", *by]).withColumn("classification", kind)


def evaluate_events(scored: DataFrame, ts: str = "Timestamp", score: str = "anomaly_score", status: str = "status", context: str = "effect_context", event: str = "event", baseline: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row an event of the rows that carry its id (direct ones and those it spreads to): coverage, detection, scores, delay.

    Coverage and strict detection count direct rows alone; the first and last alert, its phase
    and the delay in minutes from the start count related rows too.
    """
    direct, alert = F.col(context) == "direct", F.col(status) == "ALERT"
    on = lambda c, value: F.when(c, value)
    s, t = F.col(score), F.col(ts)
    extra = []
    if baseline is not None:
        b = F.col(baseline)
        extra = [F.min(on(direct, b)).alias("baseline_min"), F.max(on(direct, b)).alias("baseline_max"), F.avg(on(direct, b)).alias("baseline_mean"), F.avg(on(direct, s - b)).alias("mean_delta")]
    found = scored.where(F.col(event).isNotNull()).groupBy(*by, event).agg(
        F.min(on(direct, t)).alias("start_timestamp"), F.max(on(direct, t)).alias("end_timestamp"), F.count_if(direct).alias("direct_rows"), F.count_if(direct & alert).alias("direct_flagged"),
        F.max(on(direct, s)).alias("max_direct_score"), F.avg(on(direct, s)).alias("mean_direct_score"), F.count_if(~direct).alias("propagated_rows"), F.count_if(~direct & alert).alias("propagated_flagged"),
        F.min(on(alert, t)).alias("first_alert"), F.max(on(alert, t)).alias("last_alert"), F.min(on(alert, F.struct(ts, context)))[context].alias("first_phase"), *extra,
    )
    response = F.when(F.col("first_phase") == "direct", "during_direct").when(F.col("first_phase") == "propagated", "during_tail").otherwise("none")
    delay = seconds_between(F.col("first_alert"), F.col("start_timestamp")) / 60
    return found.select("*", F.try_divide("direct_flagged", "direct_rows").alias("coverage"), (F.col("direct_flagged") > 0).alias("detected"), delay.alias("delay_minutes"), response.alias("response"))

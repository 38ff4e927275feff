"""Reviews of a feature table: inventory, missing cells and their causes, validators of the stages, coverage, correlations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.ordering import distribution, percentiles, positions
from ..functions.scalars import blank_to_null, category, close, corr, finite, parse_number, parse_timestamp, safe_ratio
from ..functions.windows import changed, islands, micros, ordered, seconds_between
from .gram import correlations  # noqa: F401  one of the reviews

#: Which columns the review counts to which category, and its recommendations.
TIME_COLUMNS = ("Timestamp", "hour", "minute", "minute_of_day", "elapsed_minutes_from_start", "hour_sin", "hour_cos", "minute_of_day_sin", "minute_of_day_cos")
ENVIRONMENTAL = ("Air_Temp", "Relative_Humidity", "Wind_Speed", "Wind_Direction", "Solar_Radiation")
ELECTRICAL = ("Array_Voltage", "Array_Current", "Power_Generated")
DIAGNOSTIC = ("electrical_power_product", "power_consistency_residual", "power_consistency_abs_error")
CORE = ("Power_Generated", "Solar_Radiation", "Air_Temp", "Relative_Humidity", "Wind_Speed", "rtd_mean", "rtd_std", "minute_of_day_sin", "minute_of_day_cos")
EXTENDED = (
    *CORE, "Array_Current", "rtd_range", "power_generated_roll_mean_30m", "power_generated_roll_std_30m", "solar_radiation_roll_mean_30m", "solar_radiation_roll_std_30m", "rtd_mean_roll_mean_30m",
    "rtd_mean_roll_std_30m", "power_generated_diff", "solar_radiation_diff", "array_current_diff", "rtd_mean_diff", "power_deviation_from_30m_mean", "solar_deviation_from_30m_mean",
)
DAYLIGHT = ("Power_Generated", "Solar_Radiation", "power_generated_diff", "solar_radiation_diff", "power_generated_relative_change", "solar_radiation_relative_change", "power_deviation_ratio_30m", "solar_deviation_ratio_30m")
#: The inputs of the frozen detector: the core without time.
NO_TIME = tuple(c for c in CORE if not c.startswith("minute_of_day"))
ALSO_OPTIONAL = ("air_temp_diff", "relative_humidity_diff", "air_temp_roll_mean_30m", "relative_humidity_roll_mean_30m", "power_generated_roll_mean_10m", "power_generated_roll_std_10m", "solar_radiation_roll_mean_10m", "solar_radiation_roll_std_10m")
LABELS = ("synthetic_anomaly", "synthetic_anomaly_type", "synthetic_anomaly_id", "effect_context")


def candidate_feature_sets() -> dict[str, tuple[str, ...]]:
    return {"core": CORE, "extended": EXTENDED, "daylight": DAYLIGHT}


def category_of(column: str) -> str:
    groups = [
        (TIME_COLUMNS, "identifiers/time"), (ENVIRONMENTAL, "original environmental measurements"), (ELECTRICAL, "original electrical measurements"), (S.RTDS, "RTD channels"),
        (("rtd_mean", "rtd_std", "rtd_min", "rtd_max", "rtd_range"), "basic engineered features"), (DIAGNOSTIC, "diagnostic features"), (("low_light_context",), "context flags"), (S.ROLLING, "rolling features"), (S.CHANGE, "change/rate features"),
    ]
    for names, found in groups:
        if column in names:
            return found
    raise ValueError(f"not a column of the feature table: {column}")


def recommendation_of(column: str) -> str:
    if column in ("Timestamp", "low_light_context"):
        return "CONTEXT_ONLY"
    if column == "Wind_Direction":
        return "UNRESOLVED"
    if column in CORE:
        return "KEEP"
    return "OPTIONAL" if column in (*EXTENDED, *DAYLIGHT, *ALSO_OPTIONAL) else "EXCLUDE_FROM_MODEL"


def mechanism_of(column: str) -> str:
    """Why cells of the column may be missing."""
    warm_up = column in S.ROLLING or column in ("power_deviation_from_30m_mean", "solar_deviation_from_30m_mean", "power_deviation_ratio_30m")
    if warm_up:
        return "rolling_window_warm_up"
    if column.endswith(("_diff", "_rate_per_min")):
        return "first_difference_warm_up"
    if column.endswith("_relative_change"):
        return "denominator_safety"
    return "rolling_window_warm_up_and_denominator_safety" if column == "solar_deviation_ratio_30m" else "unexpected"


def expected_missing(column: str, place: Column, previous: dict[str, Column], floors: dict[str, float]) -> Column:
    """Is a missing cell of the column explained? place counts the rows of a series from 0."""
    if column in S.ROLLING:
        rows = next(n for c, s, n, w in S.ROLLING_SPECS if f"{c.lower()}_roll_{s}_{w}" == column)
        return place < rows - 1
    if column.endswith(("_diff", "_rate_per_min")):
        return place == 0
    for name, source in (("power", "Power_Generated"), ("solar", "Solar_Radiation")):
        base = F.col(f"{source.lower()}_roll_mean_30m")
        if column == f"{source.lower()}_relative_change":
            return previous[source].isNull() | (F.abs(previous[source]) < floors[source])
        if column == f"{name}_deviation_from_30m_mean":
            return base.isNull()
        if column == f"{name}_deviation_ratio_30m":
            return base.isNull() | (F.abs(base) < floors[source])
    return F.lit(False)


def long_form(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """keep..., column_name, value (double): one row a cell."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*cells)))


def variability(df: DataFrame, columns: Sequence[str], dominant: float = 0.95, least_cv: float = 0.01) -> DataFrame:
    """column_name, n_unique, mode_share, variability: constant, near_constant (one value in most rows, or little spread) or variable."""
    counts = long_form(df, columns).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("k"))
    s = counts.groupBy("column_name").agg(F.sum("k").alias("n"), F.max("k").alias("top"), F.count("*").alias("n_unique"), F.sum(F.col("k") * F.col("value")).alias("t"), F.sum(F.col("k") * F.col("value") ** 2).alias("q"))
    mean = F.col("t") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    near = (F.col("top") / F.col("n") >= dominant) | ((F.abs(mean) > 1e-12) & (F.try_divide(sd, F.abs(mean)) <= least_cv))
    kind = category(F.col("n"), [(F.col("n_unique") == 1, "constant"), (near, "near_constant")], "variable")
    return s.select("column_name", "n_unique", (F.col("top") / F.col("n")).alias("mode_share"), kind.alias("variability"))


def feature_inventory(df: DataFrame, columns: Sequence[str] = tuple(S.S81[1:]), series: str = "series", place: str = "n", power_floor: float = 1.0, solar_floor: float = 5.0) -> DataFrame:
    """One row a column: category, recommendation, rows, missing cells, unexplained ones and the mechanism, range, distinct values, variability."""
    w = ordered([series], [place])
    floors = {"Power_Generated": power_floor, "Solar_Radiation": solar_floor}
    rows = df.select(*columns, F.col(place).alias("_place"), *(F.lag(c).over(w).alias(f"_last_{c}") for c in floors))
    previous = {c: F.col(f"_last_{c}") for c in floors}
    cells = []
    for c in columns:
        value = F.col(c).cast("double")
        odd = F.col(c).isNull() & ~F.coalesce(expected_missing(c, F.col("_place"), previous, floors), F.lit(False))
        facts = [F.lit(c).alias("column_name"), F.lit(category_of(c)).alias("category"), F.lit(recommendation_of(c)).alias("recommendation"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_if(odd).alias("unexplained")]
        cells.append(F.struct(*facts, F.lit(mechanism_of(c)).alias("_mechanism"), F.min(value).alias("minimum"), F.max(value).alias("maximum")))
    facts = rows.agg(F.array(*cells).alias("x")).select(F.inline("x"))
    out = facts.join(variability(df, columns), "column_name", "left")
    return out.withColumn("mechanism", F.when(F.col("missing") == 0, "none").otherwise(F.col("_mechanism"))).drop("_mechanism")


def missing_by_width(inventory: DataFrame) -> DataFrame:
    """width, columns, missing: missing cells of the rolling columns by the width of their window."""
    width = F.regexp_extract("column_name", r"_roll_[a-z]+_(\d+m)$", 1)
    return inventory.withColumn("width", width).where("width <> ''").groupBy("width").agg(F.count("*").alias("columns"), F.sum("missing").alias("missing"))


def training_ready(inventory: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, ready, reason: may each input be trained on?"""
    wanted = inventory.sparkSession.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, place int")
    j = wanted.join(inventory, F.col("feature") == F.col("column_name"), "left")
    reason = (
        F.when(F.col("column_name").isNull(), "not_in_table").when(F.col("unexplained") > 0, "unexplained_missing").when(F.col("variability") == "constant", "constant")
        .when(F.col("recommendation").isin("CONTEXT_ONLY", "EXCLUDE_FROM_MODEL", "UNRESOLVED"), F.lower("recommendation"))
    )
    return j.select("feature", reason.isNull().alias("ready"), reason.alias("reason"))


def violations(checked: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, violations: one row a check, from one aggregation."""
    return checked.agg(F.array(*(F.struct(F.lit(k).alias("check"), F.count_if(F.coalesce(c, F.lit(False))).alias("violations")) for k, c in checks.items())).alias("x")).select(F.inline("x"))


def validate_basic(source: DataFrame, df: DataFrame, key: Sequence[str] = ("series", "n")) -> DataFrame:
    """The 31-column stage against its source and against formulas written anew."""
    S.require_columns(df, S.S31)
    base = source.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)), *(F.col(c).alias(f"_base_{c}") for c in S.S14))
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & (F.col(k) == F.col(f"_key_{i}"))
    both = df.join(base, on, "full")
    moved = F.lit(False)
    for c in S.S14:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"_base_{c}"))
    unit = lambda a, b: F.abs(F.col(a) ** 2 + F.col(b) ** 2 - 1) > 1e-9
    mean = sum((F.col(c) for c in S.RTDS[1:]), F.col(S.RTDS[0])) / 5
    square = sum(((F.col(c) - mean) ** 2 for c in S.RTDS[1:]), (F.col(S.RTDS[0]) - mean) ** 2) / 5
    checks = {
        "unmatched_rows": F.col(key[0]).isNull() | F.col("_key_0").isNull(), "measurements_changed": moved, "hour_not_on_circle": unit("hour_sin", "hour_cos"), "minute_not_on_circle": unit("minute_of_day_sin", "minute_of_day_cos"),
        "minute_of_day_differs": F.col("minute_of_day") != F.col("hour") * 60 + F.col("minute"), "rtd_out_of_order": (F.col("rtd_min") > F.col("rtd_mean") + 1e-9) | (F.col("rtd_mean") > F.col("rtd_max") + 1e-9),
        "rtd_mean_differs": ~close(F.col("rtd_mean"), mean, 1e-9, 1e-9), "rtd_std_differs": ~close(F.col("rtd_std"), F.sqrt(square), 1e-9, 1e-7), "rtd_range_differs": ~close(F.col("rtd_range"), F.col("rtd_max") - F.col("rtd_min")),
        "product_differs": ~close(F.col("electrical_power_product"), F.col("Array_Voltage") * F.col("Array_Current")), "abs_error_differs": ~close(F.col("power_consistency_abs_error"), F.abs(F.col("Power_Generated") - F.col("Array_Voltage") * F.col("Array_Current"))),
        "light_flag_differs": F.col("low_light_context") != F.coalesce((F.col("Solar_Radiation") <= 5).cast("int"), F.lit(0)), "elapsed_negative": F.col("elapsed_minutes_from_start") < 0,
    }
    return violations(both, checks)


def _windows_again(specs: Sequence[tuple[str, str, int, str]], ordered_sources: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: one row of counts a batch. Rows come series by series with their place (from 1); the rows that windows reach back to are kept.

    Numbers compare as in Spark: NaN is equal to itself and above all others.
    """
    back = max(n for *_, n, _ in specs) - 1
    frames: dict[str, set[int]] = {}
    for c, _, n, _ in specs:
        frames.setdefault(c, set()).add(n)
    wanted = {(c, s, n) for c, s, n, _ in specs}

    def values(batch, name):
        cells = batch.column(name)
        return cells.fill_null(0.0).to_numpy(zero_copy_only=False), cells.is_valid().to_numpy(zero_copy_only=False)

    def at_most(a, b):
        return (a <= b) | np.isnan(b)

    def check(batches):
        kept, last = {c: (np.zeros(back), np.zeros(back, bool)) for c in frames}, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            place = batch.column("_place").to_numpy()
            if ((place != 1) & (place != np.append(last, place[:-1]) + 1)).any():
                raise ValueError("rows did not come in the order of their series")
            last = place[-1]
            differs, misplaced, unordered = (np.zeros(rows, bool) for _ in range(3))
            again, whole, cells = {}, {}, {}
            with np.errstate(all="ignore"):
                for c in frames:
                    held, known = (np.concatenate(x) for x in zip(kept[c], values(batch, c)))
                    kept[c] = held[-back:], known[-back:]
                    for n in frames[c]:
                        window = [slice(back - k, back - k + rows) for k in range(n - 1, -1, -1)]
                        whole[c, n] = (place >= n) & np.logical_and.reduce([known[k] for k in window])
                        again[c, "mean", n] = mean = sum(held[k] for k in window) / n
                        if (c, "std", n) in wanted:
                            again[c, "std", n] = np.sqrt(sum((held[k] - mean) ** 2 for k in window) / n)
                        if (c, "min", n) in wanted:
                            again[c, "min", n] = np.fmin.reduce([held[k] for k in window])
                        if (c, "max", n) in wanted:
                            again[c, "max", n] = np.maximum.reduce([held[k] for k in window])
                for c, s, n, label in specs:
                    cell, there = cells[c, s, n] = values(batch, f"{c.lower()}_roll_{s}_{label}")
                    want = again[c, s, n]
                    differs |= whole[c, n] & ~(there & at_most(np.abs(cell - want), 1e-6 + 1e-9 * np.abs(want)))
                    misplaced |= whole[c, n] != there
                for c in ordered_sources:
                    for n in frames[c]:
                        for a, b in (("min", "mean"), ("mean", "max")):
                            (low, has_low), (high, has_high) = cells[c, a, n], cells[c, b, n]
                            unordered |= has_low & has_high & ~at_most(low, high + 1e-9)
            counts = {"value_differs": differs, "null_outside_warm_up": misplaced, "statistics_out_of_order": unordered}
            yield pa.RecordBatch.from_pydict({k: pa.array([int(x.sum())], pa.int64()) for k, x in counts.items()})

    return check


def validate_rolling(df: DataFrame, series: str = "series", place: str = "n") -> DataFrame:
    """The 61-column stage: every window computed again from its rows, nulls in the warm-up alone, order of the statistics."""
    S.require_columns(df, S.S61)
    names = list(dict.fromkeys([c for c, *_ in S.ROLLING_SPECS] + S.ROLLING))
    rows = df.select(F.row_number().over(Window.partitionBy(series).orderBy(place)).cast("long").alias("_place"), *(F.col(c).cast("double").alias(c) for c in names))
    kinds = ("value_differs", "null_outside_warm_up", "statistics_out_of_order")
    counts = rows.mapInArrow(_windows_again(S.ROLLING_SPECS, ("Power_Generated", "Solar_Radiation")), ", ".join(f"{k} long" for k in kinds))
    return counts.agg(F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(F.sum(k), F.lit(0).cast("long")).alias("violations")) for k in kinds)).alias("x")).select(F.inline("x"))


def validate_change(df: DataFrame, series: str = "series", place: str = "n", power_floor: float = 1.0, solar_floor: float = 5.0) -> DataFrame:
    """The 81-column stage: differences from a join with the row before, rates, guarded denominators, nothing infinite."""
    S.require_columns(df, S.S81)
    last = df.select(F.col(series).alias("_series"), (F.col(place) + 1).alias("_place"), *(F.col(c).alias(f"_last_{c}") for c in S.DIFFERENCED))
    rows = df.join(last, (F.col(series) == F.col("_series")) & (F.col(place) == F.col("_place")), "left")
    diff, rate, first = F.lit(False), F.lit(False), F.lit(False)
    for c in S.DIFFERENCED:
        d = F.col(f"{c.lower()}_diff")
        diff, rate = diff | ~close(d, F.col(c) - F.col(f"_last_{c}"), 1e-9, 1e-9), rate | ~close(F.col(f"{c.lower()}_rate_per_min"), d / 2)
        first = first | ((F.col(place) == 0) & d.isNotNull())
    guarded = F.lit(False)
    for name, c, floor in (("power", "Power_Generated", power_floor), ("solar", "Solar_Radiation", solar_floor)):
        before, base = F.col(f"_last_{c}"), F.col(f"{c.lower()}_roll_mean_30m")
        guarded = guarded | ~close(F.col(f"{c.lower()}_relative_change"), safe_ratio(F.col(c) - before, before, floor), 1e-9, 1e-9)
        guarded = guarded | ~close(F.col(f"{name}_deviation_ratio_30m"), safe_ratio(F.col(c) - base, base, floor), 1e-9, 1e-9) | ~close(F.col(f"{name}_deviation_from_30m_mean"), F.col(c) - base, 1e-9, 1e-9)
    largest = F.greatest(*(F.abs(F.col(c)) for c in S.CHANGE))  # passes over nulls; NaN is above all
    endless = largest.isNotNull() & ~finite(largest)
    return violations(rows, {"difference_differs": diff, "rate_differs": rate, "first_row_has_a_difference": first, "ratio_differs": guarded, "not_finite": endless})


def validate_preprocessed(raw: DataFrame, clean: DataFrame, numeric: Sequence[str], ts: str = "Timestamp", pos: str = "_pos") -> DataFrame:
    """A cleaned table against the raw text it came from, row by row on `pos`; `raw` is without duplicates."""
    typed = raw.select(F.col(pos).alias("_key"), parse_timestamp(F.trim(F.col(ts))).alias("_ts"), *(parse_number(blank_to_null(F.col(c))).alias(f"_raw_{c}") for c in numeric))
    both = clean.join(typed, F.col(pos) == F.col("_key"), "full")
    differs = F.lit(False)
    for c in numeric:
        differs = differs | ~close(F.col(c), F.col(f"_raw_{c}"), 1e-12, 1e-12)
    checks = {"row_lost": F.col(pos).isNull(), "row_added": F.col("_key").isNull(), "timestamp_differs": ~F.col(ts).eqNullSafe(F.col("_ts")), "value_differs": differs}
    return violations(both, checks)


def column_difference(before: Sequence[str], after: Sequence[str]) -> dict[str, list[str]]:
    return {"lost": [c for c in before if c not in after], "unexpected": [c for c in after if c not in before]}


def forbidden_columns(columns: Sequence[str], forbidden: Sequence[str] = LABELS) -> list[str]:
    """Columns that no training input may hold."""
    return [c for c in columns if c in forbidden]


def date_coverage(df: DataFrame, ts: str = "Timestamp", step_seconds: float = 120, by: Sequence[str] = ()) -> DataFrame:
    """by..., day, n, complete: a day is complete if it has a row a step from 00:00 to its last step."""
    day = F.to_date(ts)
    second = F.hour("_first") * 3600 + F.minute("_first") * 60 + F.second("_first")
    last = F.hour("_last") * 3600 + F.minute("_last") * 60 + F.second("_last")
    n = df.where(F.col(ts).isNotNull()).groupBy(*by, day.alias("day")).agg(F.count("*").alias("n"), F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    complete = (F.col("n") == F.lit(86400 / step_seconds)) & (second == 0) & (last == F.lit(86400 - step_seconds))
    return n.select(*by, "day", "n", complete.alias("complete"))


def negative_readings(df: DataFrame, column: str, series: str = "series", place: str = "n", ts: str = "Timestamp") -> DataFrame:
    """One row: rows below 0, their share, range and median, hours they come in, runs and the longest run."""
    w = ordered([series], [place])
    marked = df.select(series, place, ts, F.col(column).alias("value"), (F.coalesce(F.col(column) < 0, F.lit(False))).alias("_low"))
    runs = islands(marked, changed(F.col("_low"), w), w, "_run").where("_low").groupBy(series, "_run").agg(F.count("*").alias("k"))
    low = marked.where("_low")
    facts = low.agg(F.count("*").alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.sort_array(F.collect_set(F.hour(ts))).alias("hours"))  # at most 24 hours
    share = marked.agg((F.count_if("_low") * 100.0 / F.count("*")).alias("percentage"))
    length = runs.agg(F.count("*").alias("runs"), F.max("k").alias("longest_run"))
    return facts.crossJoin(percentiles(low, "value", {"median": 0.5})).crossJoin(share).crossJoin(length)  # one row each


def residual_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, n, mean, std (sample), minimum, median, maximum of each column."""
    long = long_form(df, columns)
    facts = long.groupBy("column_name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    return facts.join(percentiles(long, "value", {"median": 0.5}, ["column_name"]), "column_name")


def focused_groups(pairs: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """name, pairs, minimum, maximum of |r| among the columns of each declared group."""
    members = pairs.sparkSession.createDataFrame([(g, c) for g, cs in groups.items() for c in cs], "name string, column string")
    a, b = F.broadcast(members.withColumnRenamed("column", "a")), F.broadcast(members.withColumnRenamed("column", "b"))  # declared by hand
    inside = pairs.join(a, "a").join(b, ["b", "name"])
    return inside.groupBy("name").agg(F.count("*").alias("pairs"), F.min(F.abs("r")).alias("minimum"), F.max(F.abs("r")).alias("maximum"))


def near_events(df: DataFrame, moments: Sequence, minutes: float = 20, ts: str = "Timestamp") -> DataFrame:
    """Rows within `minutes` of a few known moments, with the moment and offset_minutes; more than 10,000 moments are an error: join them as intervals."""
    if len(moments) > 10_000:
        raise ValueError(f"{len(moments)} moments are too many to broadcast; use intervals.overlaps")
    at = df.sparkSession.createDataFrame([(str(m),) for m in moments], "moment string").select(F.col("moment").cast("timestamp_ntz").alias("moment"))
    offset = seconds_between(F.col(ts), F.col("moment")) / 60
    return df.join(F.broadcast(at), F.abs(offset) <= minutes).withColumn("offset_minutes", offset)


def aligned(near: DataFrame, value: str, first, second, by: Sequence[str] = ()) -> DataFrame:
    """Two of those moments compared offset by offset: n, Pearson r, mean absolute difference."""
    side = lambda m, name: near.where(F.col("moment") == F.lit(str(m)).cast("timestamp_ntz")).select(*by, "offset_minutes", F.col(value).alias(name))
    both = side(first, "x").join(side(second, "y"), [*by, "offset_minutes"]).where("x is not null and y is not null")
    return both.agg(F.count("*").alias("n"), corr(F.col("x"), F.col("y")).alias("r"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"))


def spike_review(df: DataFrame, column: str, event: Column, series: str = "series", ts: str = "Timestamp", minutes: float = 10) -> DataFrame:
    """series, event maximum, maximum of all other rows, mean of the neighbours within `minutes` of a row of an event, and whether the event is beyond history.

    Series without an event have no row; rows between two events that are far from both are no neighbours.
    """
    width = int(minutes * 6e7)
    rows = df.select(F.col(series).alias("_series"), micros(F.col(ts)).alias("_us"), F.col(column).alias("value"), F.coalesce(event, F.lit(False)).alias("_event"))
    tops = rows.groupBy("_series").agg(F.max(F.when(F.col("_event"), F.col("value"))).alias("event_maximum"), F.max(F.when(~F.col("_event"), F.col("value"))).alias("history_maximum"), F.count_if("_event").alias("_events"))
    slot = F.floor(F.col("_us") / F.lit(max(1, width)))
    times = rows.where("_event").select("_series", F.col("_us").alias("_at"), F.explode(F.sequence(slot - 1, slot + 1)).alias("_slot"))
    others = rows.where(~F.col("_event")).withColumn("_slot", slot)
    same = (others["_series"] == times["_series"]) & (others["_slot"] == times["_slot"]) & (F.abs(others["_us"] - times["_at"]) <= width)
    means = others.join(times, same, "left_semi").groupBy("_series").agg(F.avg("value").alias("neighbour_mean"))
    got = tops.where("_events > 0").join(means, "_series", "left")
    return got.select(F.col("_series").alias(series), "event_maximum", "history_maximum", "neighbour_mean", (F.col("event_maximum") > F.col("history_maximum")).alias("beyond_history"))


def changed_columns(baseline: DataFrame, synthetic: DataFrame, columns: Sequence[str], event: str = "synthetic_anomaly_id", key: Sequence[str] = ("series", "n")) -> DataFrame:
    """event, rows, columns: which columns differ from the baseline in the rows of each event."""
    base = baseline.select(*key, *(F.col(c).alias(f"_base_{c}") for c in columns))
    names = F.filter(F.array(*(F.when(~close(F.col(c), F.col(f"_base_{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    rows = synthetic.where(F.col(event).isNotNull()).join(base, list(key)).select(event, names.alias("_names"))
    return rows.groupBy(event).agg(F.count("*").alias("rows"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("_names")))).alias("columns"))  # sets of column names


def event_summary(df: DataFrame, columns: Sequence[str], event: str = "synthetic_anomaly_id", limits: DataFrame | None = None) -> DataFrame:
    """event, column_name, minimum, maximum, mean, outside: is the event outside the table's range (of `limits`)?"""
    got = long_form(df.where(F.col(event).isNotNull()), columns, event).groupBy(event, "column_name").agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"))
    whole = long_form(df if limits is None else limits, columns).groupBy("column_name").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    outside = (F.col("minimum") < F.col("_lo")) | (F.col("maximum") > F.col("_hi"))
    return got.join(whole, "column_name").select(event, "column_name", "minimum", "maximum", "mean", outside.alias("outside"))


def split_coverage(df: DataFrame, bounds: Sequence[tuple[str, int, int]], place: str = "n", light: str = "low_light_context", least_rows: int = 1) -> DataFrame:
    """part, n, first, last, low_light, daylight, ready: the rows of each declared range (inclusive) of places."""
    parts = df.sparkSession.createDataFrame(list(bounds), "part string, lo long, hi long")
    j = df.select(F.col(place).alias("_at"), F.col(light).alias("_light")).join(F.broadcast(parts), F.col("_at").between(F.col("lo"), F.col("hi")))  # declared by hand
    got = j.groupBy("part").agg(F.count("*").alias("n"), F.min("_at").alias("first"), F.max("_at").alias("last"), F.count_if(F.col("_light") == 1).alias("low_light"), F.count_if(F.col("_light") == 0).alias("daylight"))
    out = parts.select("part").join(got, "part", "left").fillna(0, ["n", "low_light", "daylight"])
    return out.withColumn("ready", (F.col("n") >= least_rows) & (F.col("daylight") > 0) & (F.col("low_light") > 0))


def uncovered(df: DataFrame, bounds: Sequence[tuple[str, int, int]], place: str = "n") -> DataFrame:
    """One row: rows in no range, rows in several."""
    hits = sum((F.col(place).between(lo, hi).cast("int") for _, lo, hi in bounds), F.lit(0))
    return df.agg(F.count_if(hits == 0).alias("uncovered"), F.count_if(hits > 1).alias("repeated"))


def modes(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., value, n: the most frequent value, the smallest of equals."""
    d = distribution(df, column, by)
    return d.groupBy(*by).agg(F.max(F.struct("n", (-F.col("value").cast("double")).alias("_v"))).alias("x")).select(*by, (-F.col("x._v")).alias("value"), "x.n")


def order_changed(df: DataFrame, ts: str = "Timestamp", pos: str = "_pos", by: Sequence[str] = ()) -> DataFrame:
    """One row: in how many rows is the place by time another than the place in the source?"""
    both = positions(positions(df.select(*by, ts, pos), pos, by=by, name="_source"), ts, [pos], by, "_chrono")
    return both.agg(F.count_if(F.col("_source") != F.col("_chrono")).alias("moved"))

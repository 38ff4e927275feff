"""Choosing a threshold, a feature variant and a frozen model from tables of scores.

Rules, variants and seeds are declared by the caller, a handful each: only tables of that size
are broadcast or joined by inequality. Scores stay distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import percentiles, with_group, with_ranks
from .events import group_alert_events


#: Rules are declared by hand; more than this many is a mistake.
MOST_RULES = 1000


def settled(df: DataFrame) -> DataFrame:
    """A table of a row a rule as a table of its own: what is built on it no longer carries the plan that made it."""
    rows = df.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return df.sparkSession.createDataFrame(rows, df.schema)


def candidate_thresholds(scores: DataFrame, rules: Sequence[tuple[str, str, float]], score: str = "anomaly_score") -> DataFrame:
    """declared, rule, threshold of (name, "percentile" | "mad", value) rules.

    "mad" is the median plus `value` times the median absolute deviation. An empty table gives
    null thresholds. Percentiles come from the distribution of the scores.
    """
    if wrong := [kind for _, kind, _ in rules if kind not in ("percentile", "mad")]:
        raise ValueError(f"unknown threshold rule: {wrong[0]}")
    shares = {"_median": 0.5} | {f"_p{i}": v / 100 for i, (_, kind, v) in enumerate(rules) if kind == "percentile"}
    found = percentiles(scores, score, shares)
    apart = with_group(scores.select(score), found.select("_median"), ()).select(F.abs(F.col(score) - F.col("_median")).alias("_apart"))
    stats = found.crossJoin(F.broadcast(percentiles(apart, "_apart", {"_mad": 0.5})))  # one row
    value = lambda i, kind, v: F.col(f"_p{i}") if kind == "percentile" else F.col("_median") + F.lit(float(v)) * F.col("_mad")
    rows = [F.struct(F.lit(i).alias("declared"), F.lit(name).alias("rule"), value(i, kind, v).alias("threshold")) for i, (name, kind, v) in enumerate(rules)]
    return stats.select(F.inline(F.array(*rows)))


def flag_summary(scored: DataFrame, candidates: DataFrame, ts: str = "Timestamp", score: str = "anomaly_score", low_light: Column | None = None, extreme: Column | None = None, by: tuple[str, ...] = (), gap_seconds: float = 120) -> DataFrame:
    """What each candidate flags: rows, share, events and their lengths, split by context.

    A row is flagged strictly above the threshold. `extreme_fraction` is null where nothing is
    flagged; a rule without events has length 0 and isolated fraction 0.
    """
    light = F.coalesce(low_light, F.lit(False)) if low_light is not None else F.lit(False)
    odd = F.coalesce(extreme, F.lit(False)) if extreme is not None else F.lit(False)
    rows = scored.select(*by, ts, score, light.alias("_light"), odd.alias("_odd"))
    flagged = rows.join(F.broadcast(candidates.limit(MOST_RULES)), F.col(score) > F.col("threshold"))
    counts = flagged.groupBy("rule").agg(F.count("*").alias("flagged"), F.count_if("_light").alias("low_light_flagged"), F.count_if("_odd").alias("extreme_flagged"))
    runs = group_alert_events(flagged.withColumn("_status", F.lit("ALERT")), ts, score, "_status", ("rule", *by), gap_seconds)
    lengths = runs.groupBy("rule").agg(F.count("*").alias("events"), F.max("duration_minutes").alias("maximum_minutes"), F.count_if(F.col("row_count") == 1).alias("isolated_events"))
    lengths = lengths.join(percentiles(runs, "duration_minutes", {"median_minutes": 0.5}, ["rule"]), "rule")
    total = scored.agg(F.count("*").alias("_n"))
    zero = ["flagged", "low_light_flagged", "extreme_flagged", "events", "maximum_minutes", "isolated_events"]
    out = candidates.join(counts, "rule", "left").join(lengths, "rule", "left").crossJoin(F.broadcast(total))  # one row
    out = out.fillna(0, zero).fillna(0.0, ["median_minutes"])
    return out.select(
        "declared", "rule", "threshold", "flagged", F.coalesce(F.try_divide(F.col("flagged") * 100.0, "_n"), F.lit(0.0)).alias("flagged_percentage"), "events", "median_minutes", "maximum_minutes", "isolated_events",
        F.coalesce(F.try_divide("isolated_events", "events"), F.lit(0.0)).alias("isolated_fraction"), (F.col("flagged") - F.col("low_light_flagged")).alias("daylight_flagged"), "low_light_flagged", "extreme_flagged",
        F.try_divide("extreme_flagged", "flagged").alias("extreme_fraction"),
    )


def gate_candidates(summary: DataFrame, rows: tuple[int, int], percentage: tuple[float, float], isolated: float, extreme: float) -> DataFrame:
    """Adds `eligible`: counts and shares within bounds (inclusive), few lone events, few extreme rows."""
    ok = F.col("flagged").between(*rows) & F.col("flagged_percentage").between(*percentage) & (F.col("isolated_fraction") <= isolated)
    return summary.withColumn("eligible", ok & F.coalesce(F.col("extreme_fraction") <= extreme, F.lit(False)))


def select_threshold(gated: DataFrame, target_percentage: float) -> DataFrame:
    """The eligible rule nearest to the target; ties to fewer lone events, fewer extreme rows, first declared."""
    order = [F.abs(F.col("flagged_percentage") - target_percentage), "isolated_fraction", "extreme_fraction", "declared"]
    return gated.where("eligible").orderBy(*order).limit(1)


def variant_evidence(scores: DataFrame, n_features: dict[str, int], weights: tuple[float, float, float, float], extreme: Column | None = None, compact: tuple[int, int] = (6, 9), least_std: float = 1e-6, least_tail: float = 1e-6) -> DataFrame:
    """One row a variant from (variant, partition, context, score) rows.

    The objective weighs, in this order: the absolute shift of the calibration mean in training
    deviations, the mean absolute shift over contexts, the share of calibration rows outside the
    training support (`extreme`), and the number of features between the `compact` bounds. A
    context missing on one side does not count.
    """
    s, train, cal = F.col("score"), F.col("partition") == "training", F.col("partition") == "calibration"
    odd = F.coalesce(extreme, F.lit(False)) if extreme is not None else F.lit(False)
    whole = scores.groupBy("variant").agg(
        F.avg(F.when(train, s)).alias("training_mean"), F.stddev_pop(F.when(train, s)).alias("training_std"), F.avg(F.when(cal, s)).alias("calibration_mean"),
        F.avg(F.when(cal, odd.cast("double"))).alias("extreme_fraction"),
    )
    whole = whole.join(percentiles(scores.where(train), "score", {"_p90": 0.9, "_p99": 0.99}, ["variant"]), "variant")
    contexts = scores.groupBy("variant", "context").agg((F.avg(F.when(cal, s)) - F.avg(F.when(train, s))).alias("_shift"))
    found = whole.join(contexts.groupBy("variant").agg(F.avg(F.abs("_shift")).alias("_context")), "variant")
    size = F.create_map(*[F.lit(x) for pair in n_features.items() for x in pair])[F.col("variant")]
    place = F.create_map(*[F.lit(x) for pair in ((name, i) for i, name in enumerate(n_features)) for x in pair])[F.col("variant")]
    shift = F.try_divide(F.abs(F.col("calibration_mean") - F.col("training_mean")), "training_std")
    parts = [shift, F.try_divide("_context", "training_std"), F.coalesce("extreme_fraction", F.lit(0.0)), (size - compact[0]) / F.lit(float(compact[1] - compact[0]))]
    names = ["shift_z", "context_shift_z", "extreme_fraction", "compactness"]
    objective = sum(p * F.lit(float(w)) for p, w in zip(parts, weights))
    eligible = (F.col("training_std") >= least_std) & (F.col("_p99") - F.col("_p90") >= least_tail)
    return found.select("variant", place.alias("declared"), size.alias("n_features"), *(p.alias(n) for p, n in zip(parts, names)), objective.alias("objective"), F.coalesce(eligible, F.lit(False)).alias("eligible"))


def select_variant(evidence: DataFrame) -> DataFrame:
    return evidence.where("eligible").orderBy("objective", "n_features", "declared").limit(1)


def rank_stability(scores: DataFrame, key: str = "Timestamp", run: str = "seed", score: str = "anomaly_score", tops: Sequence[int] = (10, 20)) -> DataFrame:
    """Spearman and overlap of the top rows for each pair of runs (seeds, variants).

    Pairs are of runs, joined on the key: the join grows with the rows times the handful of runs.
    """
    best = Window.partitionBy(run).orderBy(F.col(score).desc(), F.col(key))
    rows = scores.select(run, key, score)
    leaders = rows.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= max(tops)).select(run, key, "_place")  # cut before the shuffle
    ranked = with_ranks(rows, score, [run], ("_rank", "_desc", "_share")).join(leaders, [run, key], "left").select(run, key, "_rank", "_place")
    a, b = ranked.alias("a"), ranked.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{run}") < F.col(f"b.{run}")))
    both = lambda k: F.count_if((F.col("a._place") <= k) & (F.col("b._place") <= k)).alias(f"top_{k}_overlap")
    x, y = F.col("a._rank"), F.col("b._rank")
    rho = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return pairs.groupBy(F.col(f"a.{run}").alias("left"), F.col(f"b.{run}").alias("right")).agg(rho.alias("spearman"), *(both(k) for k in tops))


def freeze_gates(stability: DataFrame, least: float, median: float, top: int, overlap: float) -> DataFrame:
    """One row of booleans: may the model be frozen? No pairs: nothing passes."""
    s = stability.agg(F.min("spearman").alias("_least"), F.percentile("spearman", F.lit(0.5)).alias("_median"), F.avg(f"top_{top}_overlap").alias("_top"))
    checks = {"minimum_spearman": F.col("_least") >= least, "median_spearman": F.col("_median") >= median, "mean_top_overlap": F.col("_top") >= overlap}
    checks = {k: F.coalesce(c, F.lit(False)) for k, c in checks.items()}
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    return s.select(*(c.alias(k) for k, c in checks.items()), every.alias("freeze"))


def freeze_criteria(stability: DataFrame, shifts: DataFrame, variants: DataFrame, extremes_in_top: DataFrame, inputs: Sequence[str], needed: Sequence[str], least: float, overlaps: dict[int, float], most_extremes: int, variant: str = "no_time", wider: str = "core", narrower: str = "compact") -> DataFrame:
    """One row of five booleans and `freeze`, their conjunction: may a variant be frozen?

    ranks_agree: the least Spearman of two seeds is at least `least`, the mean share of the top k that two seeds have in common
    at least overlaps[k] (stability as from `rank_stability`); shift_below_wider: every seed's calibration shift (shifts: seed, shift) is
    smaller than the wider variant's (variants: variant, shift); extremes_do_not_fill_top: extremes_in_top (one row, n) is at most
    `most_extremes`; inputs_complete: the inputs are the needed ones, each once; narrower_no_better: the narrower variant's
    shift is the larger. Where a number is missing its gate does not pass.
    """
    s = stability.agg(F.min("spearman").alias("_least"), *(F.avg(F.col(f"top_{k}_overlap") / k).alias(f"_top_{k}") for k in overlaps))
    of = lambda name: F.max(F.when(F.col("variant") == name, F.col("shift"))).alias(f"_{name}")
    v = variants.agg(of(wider), of(narrower), of(variant))
    seeds = shifts.agg(F.max(F.abs("shift")).alias("_largest"), F.count_if(F.col("shift").isNull()).alias("_unknown"), F.count("*").alias("_seeds"))
    top = extremes_in_top.agg(F.max("n").alias("_extremes"))
    row = s.crossJoin(v).crossJoin(seeds).crossJoin(top)  # one row each
    agree = F.col("_least") >= least
    for k, share in overlaps.items():
        agree = agree & (F.col(f"_top_{k}") >= share)
    checks = {
        "ranks_agree": agree, "shift_below_wider": (F.col("_seeds") > 0) & (F.col("_unknown") == 0) & (F.col("_largest") < F.abs(F.col(f"_{wider}"))), "extremes_do_not_fill_top": F.col("_extremes") <= most_extremes,
        "inputs_complete": F.lit(len(set(inputs)) == len(inputs) and set(inputs) == set(needed)), "narrower_no_better": F.col(f"_{variant}") < F.col(f"_{narrower}"),
    }
    checks = {k: F.coalesce(c, F.lit(False)) for k, c in checks.items()}
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    return row.select(*(c.alias(k) for k, c in checks.items()), every.alias("freeze"))

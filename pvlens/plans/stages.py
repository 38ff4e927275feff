"""The stages end to end: each takes tables, runs its operators, checks the result and returns tables. Nothing is written but where a folder is named."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import calibration, events, features, freeze, gates, profile, review, scores, serving, synthetic
from ..operators.iforest import fit, score
from ..sources import operational, publish
from ..sources.folders import working_folder


def passed(report: DataFrame, name: str) -> DataFrame:
    """The report, if no check of it counts a violation."""
    if wrong := {r.check: r.violations for r in report.where("violations > 0").collect()}:  # a row a check
        raise ValueError(f"{name}: " + ", ".join(f"{k} in {n} rows" for k, n in wrong.items()))
    return report


def clean(spark: SparkSession, path: str, numeric: Sequence[str] = tuple(S.MEASUREMENTS)) -> dict[str, DataFrame]:
    """Raw CSV files to the typed table of 14 columns: table, profile, summary, checks."""
    raw = operational.read_text_columns(spark, path).drop("_file")
    once = operational.drop_duplicates(raw)
    typed = operational.typed(once, numeric=numeric)
    checks = passed(review.validate_preprocessed(once, typed, numeric), "clean")
    return {"table": typed, "profile": profile.timestamp_profile(typed, S.TIMESTAMP, "_pos"), "summary": profile.cleaning_summary(raw, typed, numeric), "checks": checks}


def engineer(df: DataFrame, series: str, place: str) -> dict[str, DataFrame]:
    """14 columns to 81, validated after every stage: table, inventory, missing by width.

    The table is computed once, by the job that writes it and checks the measurements; all that follows reads what was written.
    """
    spark = df.sparkSession
    contract = publish.Contract(ts=S.TIMESTAMP, series=[series], unique=True, finite=S.MEASUREMENTS)
    out = publish.publish(features.features(df, series), working_folder(spark, "engineered"), contract)
    passed(review.validate_basic(df, out, (series, place)), "basic")
    passed(review.validate_rolling(out, series, place), "rolling")
    passed(review.validate_change(out, series, place), "change")
    inventory = review.feature_inventory(out, series=series, place=place)
    return {"table": out, "inventory": inventory, "missing_by_width": review.missing_by_width(inventory)}


def split_by_time(df: DataFrame, bounds: Sequence[tuple[str, str, str]], folder: str, ts: str = S.TIMESTAMP, rows: dict[str, int] | None = None, by: Sequence[str] = (), name: str = "partition") -> DataFrame:
    """df with the partition that each row's time lies in, written to `folder` by the job that checks it, and read again.

    bounds: name, first and last time (both inclusive), in order and apart. Every row lies in exactly one; both bounds of each are
    times of the table (with `by`, of some series); rows: how many each must hold. No time is missing or comes twice in a
    series. Anything else is an error, and nothing is published.
    """
    spans = [(n, F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")) for n, lo, hi in bounds]
    for (a, _, end), (b, start, _) in zip(bounds, bounds[1:]):
        if start <= end:
            raise ValueError(f"{b} begins before {a} ends")
    part = F.lit(None).cast("string")
    for n, lo, hi in reversed(spans):
        part = F.when(F.col(ts).between(lo, hi), n).otherwise(part)
    own = lambda n: F.col(name).eqNullSafe(F.lit(n))
    checks: dict[str, Column] = {"in_no_partition": F.col(name).isNull()}
    contract = publish.Contract(ts=ts, series=by, unique=True, checks=checks, bounds={n: (own(n), F.col(ts), lo, hi, (rows or {}).get(n)) for n, lo, hi in bounds})
    return publish.publish(df.withColumn(name, part), folder, contract)


def quality_review(df: DataFrame, series: str, place: str) -> dict[str, DataFrame]:
    return {
        "ranges": profile.range_flags(df), "dates": review.date_coverage(df, by=[series]), "negative": review.negative_readings(df, "Solar_Radiation", series, place),
        "variability": review.variability(df, S.MEASUREMENTS), "correlations": review.correlations(df, S.MEASUREMENTS),
    }


def split(df: DataFrame, bounds: Sequence[tuple[str, int, int]], place: str, features_: Sequence[str] = review.CORE) -> dict[str, DataFrame]:
    """Every row in exactly one partition; the inputs, their statistics and the shift of their means."""
    if wrong := review.forbidden_columns(features_):
        raise ValueError(f"labels among the inputs: {', '.join(wrong)}")
    gaps = review.uncovered(df, bounds, place).first()
    if gaps.uncovered or gaps.repeated:
        raise ValueError(f"{gaps.uncovered} rows in no partition, {gaps.repeated} in several")
    part = F.lit(None).cast("string")
    for name, lo, hi in bounds:
        part = F.when(F.col(place).between(lo, hi), name).otherwise(part)
    out = df.withColumn("partition", part)
    statistics = scores.scaler_review(out, features_)
    return {"table": out, "statistics": statistics, "shifts": scores.mean_shifts(statistics), "coverage": review.split_coverage(df, bounds, place)}


def train(parts: DataFrame, inputs: Sequence[str], key: str, keep: Sequence[str] = (), **options) -> tuple[serving.Detector, DataFrame]:
    """The detector of the training rows alone, and the scores of all rows."""
    found = serving.fit_detector(parts.where("partition = 'training'"), inputs, key, **options)
    own = [key, "partition", *keep]
    return found, serving.score_frame(parts, found, own).select(*own, "anomaly_score")


def investigate(scored: DataFrame, context: str, ts: str = S.TIMESTAMP) -> dict[str, DataFrame]:
    return {"statistics": scores.score_statistics(scored), "contexts": scores.context_statistics(scored, ("partition", context)), "top": scores.top_rows(scored, ts=ts), "top_summary": scores.top_summary(scored, ts=ts, context=context)}


def compare(parts: DataFrame, variants: dict[str, Sequence[str]], key: str, weights: tuple[float, float, float, float], context: str, **options) -> dict[str, DataFrame]:
    """Evidence for each variant from training and calibration rows, and the choice; evaluation rows are not scored."""
    seen = parts.where("partition in ('training', 'calibration')")
    rows = None
    for name, inputs in variants.items():
        _, scored = train(seen, inputs, key, (context,), **options)
        own = scored.select(F.lit(name).alias("variant"), "partition", F.col(context).alias("context"), F.col("anomaly_score").alias("score"), F.col(key))
        rows = own if rows is None else rows.unionByName(own)
    evidence = calibration.variant_evidence(rows, {k: len(v) for k, v in variants.items()}, weights)
    overlap = calibration.rank_stability(rows.where("partition = 'calibration'"), key, "variant", "score")
    return {"evidence": evidence, "choice": calibration.select_variant(evidence), "overlap": overlap}


def stability(parts: DataFrame, inputs: Sequence[str], key: str, seeds: Sequence[int], least: float, median: float, overlap: float, **options) -> dict[str, DataFrame]:
    """Calibration scores under several seeds, how well they agree, and whether the model may be frozen."""
    training, seen = parts.where("partition = 'training'"), parts.where("partition = 'calibration'")
    scaler = scores.scaler_values(scores.fit_scaler(training, inputs))
    rows = None
    for seed in seeds:
        forest = fit(scores.scaled(training.select(key, *inputs), scaler), inputs, key, seed=seed, **options)
        own = score(scores.scaled(seen.select(key, *inputs), scaler), forest, inputs).select(key, F.lit(seed).alias("seed"), "anomaly_score")
        rows = own if rows is None else rows.unionByName(own)
    agreed = calibration.rank_stability(rows, key)
    return {"scores": rows, "pairs": agreed, "gates": calibration.freeze_gates(agreed, least, median, 20, overlap)}


def calibrate(scored: DataFrame, rules: Sequence[tuple[str, str, float]], rows: tuple[int, int], percentage: tuple[float, float], isolated: float, extreme: float, target: float, by: tuple[str, ...] = (), low_light: Column | None = None, odd: Column | None = None, chain: str | None = None) -> dict[str, DataFrame]:
    """Candidates from the calibration rows, what each flags, and the choice; then a look at the evaluation rows with the frozen threshold.

    chain: a folder in which the choice is frozen first; the evaluation rows are read only against that manifest.
    """
    seen = scored.where("partition = 'calibration'")
    candidates = calibration.settled(calibration.candidate_thresholds(seen, rules))
    summary = calibration.flag_summary(seen, candidates, low_light=low_light, extreme=odd, by=by)
    gated = calibration.settled(calibration.gate_candidates(summary, rows, percentage, isolated, extreme))
    choice = calibration.settled(calibration.select_threshold(gated, target))
    kept = scored.where("partition = 'evaluation'")
    if chain is not None:
        picked = freeze.choice_of(choice)
        freeze.freeze(scored.sparkSession, chain, "threshold", picked, {"rules": serving.canonical_hash([list(r) for r in rules])})
        kept = freeze.opened(scored, F.col("partition") == "evaluation", chain, "threshold", freeze.choice_of(choice))
    after = calibration.flag_summary(kept, choice.select("declared", "rule", "threshold"), low_light=low_light, extreme=odd, by=by)
    return {"candidates": gated, "choice": choice, "evaluation": after}


def generate(df: DataFrame, scenarios: Sequence[synthetic.Scenario], ok: dict[str, Column], forbidden: Column, seed: int, series: str, pos: str = "_pos", **options) -> dict:
    """A synthetic copy of one series with all features computed again: events, skipped, table, checks."""
    chosen, skipped = synthetic.place(df, scenarios, ok, forbidden, seed, pos=pos, **options)
    copy = synthetic.inject(df, chosen, scenarios, pos)
    checks = passed(synthetic.check_copy(df, copy, chosen, scenarios, S.MEASUREMENTS, pos=pos, gap_rows=options.get("gap_rows", 30), share=options.get("share", 0.05)), "synthetic copy")
    again = features.features(copy, series)
    return {"events": chosen, "skipped": skipped, "table": synthetic.effect_context(features.features(df, series), again, S.S81[1:], [pos]), "checks": checks}


def evaluate(baseline: DataFrame, copy: DataFrame, detector: serving.Detector, key: Sequence[str], by: tuple[str, ...] = (), chain: str | None = None) -> dict[str, DataFrame]:
    """Scores of a copy and of its untouched twin: paired rows, confusion, differences, events and alert events.

    chain: the folder in which this detector was frozen as step `detector`; another one is an error.
    """
    if chain is not None:
        freeze.demanded(copy.sparkSession, chain, "detector", detector.hashes())
    labels = ["synthetic_anomaly", "synthetic_anomaly_id", "effect_context"]
    gates.labels_gate(copy)
    own = [*key, *[c for c in (S.TIMESTAMP,) if c not in key]]
    scored = serving.score_frame(copy, detector, [*own, *labels])
    base = serving.score_frame(baseline, detector, list(key)).select(*key, F.col("anomaly_score").alias("baseline"))
    both = scored.join(base, list(key)).withColumn("score_delta", F.col("anomaly_score") - F.col("baseline")).withColumn("event", F.col("synthetic_anomaly_id"))
    predicted = both.withColumn("predicted", (F.col("status") == "ALERT").cast("int"))
    runs = events.group_alert_events(both, by=by)
    return {
        "paired": both, "confusion": events.confusion(predicted, "synthetic_anomaly", "predicted"), "delta": scores.delta_summary(both), "events": events.evaluate_events(both, baseline="baseline", by=by),
        "alerts": events.classify_alert_events(both, runs, by=by),
    }


def review_copy(baseline: DataFrame, copy: DataFrame, columns: Sequence[str], key: Sequence[str]) -> dict[str, DataFrame]:
    return {"contexts": copy.groupBy("effect_context").agg(F.count("*").alias("rows")), "changed": review.changed_columns(baseline, copy, columns, key=key), "summary": review.event_summary(copy, columns, limits=baseline)}


def export_feed(df: DataFrame, detector: serving.Detector, folder: str, by: Sequence[str] = ()) -> DataFrame:
    """The replay feed, gated and written; what was written is read back."""
    gates.feed_gate(serving.feed(df, detector, by=by)).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)

"""Threshold rules, variants, stability, synthetic events, gates, sinks and replay, on small tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvlens.operators import calibration, gates, synthetic
from pvlens.sources import reports
from pvlens.streaming import replay

START = dt.datetime(2022, 4, 27)


def series(spark, n, score=lambda i: float(i), skip=()):
    rows = [(i, START + dt.timedelta(minutes=2 * i), float(score(i)), 200.0, 100.0 + i) for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, "_pos long, Timestamp timestamp, anomaly_score double, Solar_Radiation double, Power_Generated double")


def test_candidate_thresholds_match_numpy(spark):
    values = np.random.default_rng(3).normal(size=101)
    df = series(spark, 101, lambda i: values[i])
    rules = [("p95", "percentile", 95.0), ("p97_5", "percentile", 97.5), ("mad_2", "mad", 2.0)]
    got = {r.rule: r.threshold for r in calibration.candidate_thresholds(df, rules).collect()}
    mad = np.median(np.abs(values - np.median(values)))
    assert got == pytest.approx({"p95": np.quantile(values, 0.95), "p97_5": np.quantile(values, 0.975), "mad_2": np.median(values) + 2 * mad})
    assert [r.threshold for r in calibration.candidate_thresholds(df.limit(0), rules).collect()] == [None] * 3
    with pytest.raises(ValueError):
        calibration.candidate_thresholds(df, [("x", "other", 1.0)])


def test_flag_summary_gates_and_selection(spark):
    high = {3, 4, 5, 20, 40, 41}
    df = series(spark, 100, lambda i: 0.9 if i in high else 0.1)
    rules = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.95)], "declared int, rule string, threshold double")
    found = calibration.flag_summary(df, rules, low_light=F.col("_pos") < 10, extreme=F.col("_pos") == 20)
    a, b = found.orderBy("declared").collect()
    assert (a.flagged, a.events, a.median_minutes, a.maximum_minutes, a.isolated_events, a.low_light_flagged, a.daylight_flagged, a.extreme_flagged) == (6, 3, 4.0, 6, 1, 3, 3, 1)
    assert (b.flagged, b.events, b.isolated_fraction, b.extreme_fraction) == (0, 0, 0.0, None)
    gated = calibration.gate_candidates(found, (4, 18), (1.0, 6.5), 0.75, 0.8)
    assert [r.rule for r in calibration.select_threshold(gated, 2.5).collect()] == ["a"]


def test_variant_evidence_by_hand(spark):
    rows = [("v", "training", "day", 1.0), ("v", "training", "low", 3.0), ("v", "calibration", "day", 2.0), ("v", "calibration", "low", 6.0), ("w", "training", "day", 1.0), ("w", "calibration", "day", 1.0)]
    df = spark.createDataFrame(rows, "variant string, partition string, context string, score double")
    got = {r.variant: r for r in calibration.variant_evidence(df, {"v": 9, "w": 6}, (0.45, 0.35, 0.15, 0.05)).collect()}
    assert got["v"].objective == pytest.approx(0.45 * 2 + 0.35 * 2 + 0.05)
    assert got["v"].eligible and not got["w"].eligible
    assert calibration.select_variant(calibration.variant_evidence(df, {"v": 9, "w": 6}, (1, 1, 1, 1))).first().variant == "v"


def test_rank_stability_and_freeze(spark):
    rows = [(seed, i, float(i if seed < 2 else -i)) for seed in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "seed int, k long, anomaly_score double")
    got = {(r.left, r.right): r for r in calibration.rank_stability(df, "k").collect()}
    assert got[0, 1].spearman == pytest.approx(1) and got[0, 2].spearman == pytest.approx(-1)
    assert (got[0, 1].top_10_overlap, got[0, 2].top_10_overlap, got[0, 2].top_20_overlap) == (10, 0, 10)
    found = calibration.rank_stability(df.where("seed < 2"), "k")
    assert calibration.freeze_gates(found, 0.9, 0.95, 10, 5).first().freeze
    assert not calibration.freeze_gates(found.limit(0), 0.9, 0.95, 10, 5).first().freeze


def positioned(spark, rows):
    return spark.createDataFrame(rows, "_pos long, Timestamp timestamp_ntz, Power_Generated double")


def test_rooms_against_a_loop(spark):
    start = dt.datetime(2022, 5, 1)
    n, tail, most = 200, 6, 5
    rows = [(i, start + dt.timedelta(minutes=2 * i + (1 if i in (60, 120) else 0)), float(i % 17)) for i in range(n)]
    ok, forbidden = F.col("Power_Generated") > 3, F.col("_pos").isin(30, 150)
    got = {r._pos: r.rooms.x for r in synthetic.rooms(positioned(spark, rows), {"x": most}, {"x": ok}, forbidden, tail).collect()}
    even = [i == 0 or (rows[i][1] - rows[i - 1][1]).total_seconds() == 120 for i in range(n)]
    for p in range(n):
        room = 0
        for length in range(1, most + 1):
            inside, guard = range(p, p + length), range(p, min(n, p + length + tail))
            if p + length <= n and all(rows[i][2] > 3 for i in inside) and all(even[i] and i not in (30, 150) for i in guard):
                room = length
        assert got[p] == room, p


def test_room_beside_events(spark):
    df = spark.range(60).select(synthetic.room_beside(F.lit(5), F.col("id"), [(20, 24)], 10).alias("room"), "id")
    got = {r.id: r.room for r in df.collect()}
    for p in range(60):
        fits = [n for n in range(1, 6) if p + n + 10 <= 20 or p >= 34]
        assert got[p] == max(fits, default=0), p


def test_place_inject_check_and_context(spark):
    start = dt.datetime(2022, 5, 1)
    df = positioned(spark, [(i, start + dt.timedelta(minutes=2 * i), 100.0 + i % 9) for i in range(400)]).withColumn("Air_Temp", F.lit(20.0)).persist()
    plan = [
        synthetic.Scenario("drop", ("Power_Generated",), (4, 6), (0.2, 0.4), "lower"), synthetic.Scenario("slope", ("Power_Generated",), (5, 5), (0.5, 0.5), "fade"),
        synthetic.Scenario("never", ("Power_Generated",), (3, 3), (0.5, 0.5), "raise"), synthetic.Scenario("still", ("Power_Generated",), (2, 2), (0.0, 0.0), "raise"),
        synthetic.Scenario("sensor", ("Air_Temp", "Power_Generated"), (2, 3), {"Air_Temp": (4.0, 8.0), "Power_Generated": (30.0, 50.0)}, "offset"),
    ]
    ok = {s.name: F.lit(s.name != "never") for s in plan}
    events, skipped = synthetic.place(df, plan, ok, F.lit(False), seed=7)
    assert (events, skipped) == synthetic.place(df, plan, ok, F.lit(False), seed=7)
    assert [e["scenario"] for e in events] == ["slope", "drop", "sensor"] and [(x["scenario"], x["reason"]) for x in skipped] == [("never", "no_place"), ("still", "no_effect")]
    taken = sorted((e["start"], e["start"] + e["n_rows"]) for e in events)
    assert all(b[0] - a[1] >= 30 for a, b in zip(taken, taken[1:])) and len(events[2]["columns"]) == 1
    out = synthetic.inject(df, events, plan)
    slope = events[0]
    got = {r._pos: r.Power_Generated for r in out.collect()}
    for j in range(5):
        p = slope["start"] + j
        assert abs(got[p] - (100.0 + p % 9) * (1 - 0.5 * (j + 1) / 5)) < 1e-9
    checks = {r.check: r.violations for r in synthetic.check_copy(df, out, events, plan, ["Power_Generated", "Air_Temp"]).collect()}
    assert len(checks) == 15 and not any(checks.values())
    wrong = out.withColumn("Air_Temp", F.when(F.col("_pos") == 3, 99.0).otherwise(F.col("Air_Temp"))).withColumn("synthetic_anomaly", F.when(F.col("_pos") == slope["start"], 0).otherwise(F.col("synthetic_anomaly")))
    checks = {r.check for r in synthetic.check_copy(df, wrong, events, plan, ["Power_Generated", "Air_Temp"]).collect() if r.violations}
    assert checks == {"changed_without_label", "column_not_of_the_event", "event_row_unlabelled"}
    context = synthetic.effect_context(df, out.withColumn("Power_Generated", F.when(F.col("_pos") == 0, 1.0).otherwise(F.col("Power_Generated"))), ["Power_Generated", "Air_Temp"])
    n = {r.effect_context: r["count"] for r in context.groupBy("effect_context").count().collect()}
    direct = sum(e["n_rows"] for e in events)
    assert n == {"direct": direct, "none": 400 - direct - (0 not in range(*taken[0])), "propagated": 1} or 0 in range(*taken[0])


def test_influence_and_restore(spark):
    df = spark.range(20).select(F.col("id").alias("_pos"), F.col("id").cast("double").alias("x"))
    marked = synthetic.influenced(df, F.col("_pos") == 4, 3)
    assert [r._pos for r in marked.where("_influenced").orderBy("_pos").collect()] == [4, 5, 6, 7]
    out = synthetic.restored(df, marked.withColumn("x", F.lit(-1.0)), ["x"], key=["_pos"])
    assert [r.x for r in out.orderBy("_pos").collect()] == [-1.0 if 4 <= i <= 7 else float(i) for i in range(20)]


def test_gates(spark):
    df = series(spark, 5)
    gates.timestamp_gate(df, pos="_pos", cadence=120)
    gates.numeric_gate(df, ["anomaly_score"])
    for broken in (df.union(df.limit(1)), df.withColumn("Timestamp", F.when(F.col("_pos") > 0, F.col("Timestamp")))):
        with pytest.raises(ValueError, match="timestamp"):
            gates.timestamp_gate(broken)
    with pytest.raises(ValueError, match="not_finite"):
        gates.numeric_gate(df.withColumn("anomaly_score", F.lit(math.inf)), ["anomaly_score"])
    labels = "synthetic_anomaly int, effect_context string"
    gates.labels_gate(spark.createDataFrame([(0, "none"), (1, "direct"), (0, "propagated")], labels))
    for row in ((2, "none"), (1, "propagated"), (0, "x"), (None, "none")):
        with pytest.raises(ValueError):
            gates.labels_gate(spark.createDataFrame([row], labels))
    feed = df.select("anomaly_score", F.lit(2.0).alias("threshold"), (F.col("anomaly_score") - 2).alias("threshold_margin"), F.when(F.col("anomaly_score") > 2, "ALERT").otherwise("NORMAL").alias("status"))
    gates.feed_gate(feed)
    with pytest.raises(ValueError, match="status_differs in 2"):
        gates.feed_gate(feed.withColumn("status", F.lit("NORMAL")))
    assert gates.paired(df, df).count() == 5
    with pytest.raises(ValueError, match="unmatched"):
        gates.paired(df, df.where("_pos > 0"))


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0.1 + 0.2, "a"), (math.nan, "b"), (math.inf, None), (None, "d")], "x double, s string")
    reports.write_json(df, str(tmp_path / "j"))
    got = reports.read_json_report(spark, str(tmp_path / "j"), "x double, s string").collect()
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert len(got) and "NaN" not in text and "Infinity" not in text and text.count("null") == 4
    reports.write_csv(df.limit(1), str(tmp_path / "c"))
    assert spark.read.option("header", True).schema("x double, s string").csv(str(tmp_path / "c")).first().x == 0.1 + 0.2


def test_quarantine_plan(spark):
    review = [("train", f"train/images/{c}.jpg", "NEEDS_MANUAL_REVIEW", "true") for c in "abcd"] + [("x", "x/images/e.jpg", "NEEDS_MANUAL_REVIEW", "true"), ("val", "val/images/f.jpg", "DONE", "true"), ("val", "train/images/g.jpg", "NEEDS_MANUAL_REVIEW", "true"), ("val", "val/images/../h.jpg", "NEEDS_MANUAL_REVIEW", "true")]
    files = [(f"train/images/{c}.jpg", 9, c) for c in "abd"] + [("train/labels/a.txt", 0, "0"), ("train/labels/b.txt", 4, "1"), ("train/labels/d.txt", 0, "0"), ("quarantine/train/images/d.jpg", 9, "d")]
    plan = reports.quarantine_plan(spark.createDataFrame(review, "split string, image_path string, review_status string, empty_label string"), spark.createDataFrame(files, "path string, length long, sha256 string"))
    got = {r.image_path[-5]: r.problem for r in plan.collect()}
    assert got == {"a": None, "b": "label_has_text", "c": "no_image", "d": "occupied", "e": "split", "f": "status", "g": "outside", "h": "outside"}


def test_replay_runs_cross_steps(spark, tmp_path):
    high = {3, 4, 5, 6, 9, 12, 13}
    for part, (a, b) in enumerate([(0, 5), (5, 10), (10, 15)]):
        rows = series(spark, 15, lambda i: 0.9 if i in high else 0.1).where(F.col("_pos").between(a, b - 1)).withColumn("series", F.lit("s"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    runs = replay.alert_runs(replay.with_status(replay.read_replay(spark, str(tmp_path / "in"), schema), 0.5))
    q = runs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.row_count, r.start_timestamp) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, START + dt.timedelta(minutes=18)), (2, START + dt.timedelta(minutes=24)), (4, START + dt.timedelta(minutes=6))]

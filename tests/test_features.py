"""Causal features on small literal frames."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pvlens import schema as S
from pvlens.operators.events import confusion, group_alert_events
from pvlens.operators.features import features
from pvlens.operators.vision import parse_label_lines
from pvlens.sources.operational import load


def ramp(spark, n=35, spike=None):
    rows = []
    for i in range(n):
        v = float(i + 1)
        power = 10000.0 if i == spike else v
        rows.append((datetime(2022, 1, 1) + timedelta(minutes=2 * i), 20 + v, 80 - v, v / 10, (10 * v) % 360, 2 * v, *(29 + k + v for k in range(1, 6)), v / 5, 5.0, power))
    return spark.createDataFrame(rows, S.S14).withColumn(S.TIMESTAMP, F.col(S.TIMESTAMP).cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def ramped(spark):
    return features(ramp(spark)).orderBy(S.TIMESTAMP).collect()


def test_layout(spark):
    assert features(ramp(spark)).columns == S.S81
    assert (len(S.S14), len(S.S31), len(S.S61), len(S.S81)) == (14, 31, 61, 81)


def test_rolling_is_full_and_trailing(ramped):
    assert all(ramped[i]["power_generated_roll_mean_10m"] is None for i in range(4))
    r = ramped[4]
    assert (r["power_generated_roll_mean_10m"], r["power_generated_roll_min_10m"]) == (3.0, 1.0)
    assert math.isclose(r["power_generated_roll_std_10m"], math.sqrt(2), rel_tol=1e-9)
    r = ramped[14]
    assert (r["power_generated_roll_mean_30m"], r["solar_radiation_roll_max_30m"], r["air_temp_roll_mean_30m"], r["rtd_mean_roll_mean_30m"]) == (8.0, 30.0, 28.0, 40.0)
    assert ramped[29]["relative_humidity_roll_mean_60m"] == 64.5


def test_change(ramped):
    assert ramped[0]["power_generated_diff"] is None
    assert (ramped[1]["power_generated_diff"], ramped[1]["power_generated_rate_per_min"]) == (1.0, 0.5)
    assert ramped[14]["power_deviation_from_30m_mean"] == 7.0
    assert math.isclose(ramped[14]["power_deviation_ratio_30m"], 7 / 8)


def test_causal(spark, ramped):
    spiked = features(ramp(spark, spike=5)).orderBy(S.TIMESTAMP).collect()
    assert spiked[4] == ramped[4]
    assert spiked[5] != ramped[5]


def test_alert_events(spark):
    minutes, scores = (0, 2, 5, 7, 9, 11), (0.8, 0.9, 1.0, 0.1, 1.1, 1.2)
    rows = [(datetime(2022, 1, 1) + timedelta(minutes=m), s, "NORMAL" if s < 0.5 else "ALERT") for m, s in zip(minutes, scores)]
    df = spark.createDataFrame(rows, "Timestamp timestamp_ntz, anomaly_score double, status string")
    out = group_alert_events(df).orderBy("event_id").collect()
    assert [(r.event_id, r.row_count, r.duration_minutes, r.maximum_anomaly_score) for r in out] == [("alert-001", 2, 4, 0.9), ("alert-002", 1, 2, 1.0), ("alert-003", 2, 4, 1.2)]
    assert group_alert_events(df.where("anomaly_score > 5")).count() == 0


def test_confusion_without_alerts(spark):
    df = spark.createDataFrame([(1, 0)] * 21 + [(0, 0)] * 316, "t int, p int")
    r = confusion(df, "t", "p").first()
    assert (r.tp, r.fp, r.tn, r.fn, r.precision, r.recall, r.f1) == (0, 0, 316, 21, 0.0, 0.0, 0.0)
    assert math.isclose(r.accuracy, 316 / 337)


def test_loader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,Air_Temp,Power_Generated\n01-05-2022 00:04,22,101\n01-05-2022 00:00,20,99\n01-05-2022 00:00,20,99\n01-05-2022 00:02,not-numeric,100\n")
    rows = load(spark, str(tmp_path)).collect()
    assert [r.Power_Generated for r in rows] == [99.0, 100.0, 101.0]
    assert [r.Air_Temp for r in rows] == [20.0, None, 22.0]
    assert load(spark, str(tmp_path), keep=None).count() == 4


def test_label_lines(spark):
    lines = ["0 .5 .5 .2 .2", "0 .5 .5 .2", "x .5 .5 .2 .2", "2 .5 .5 .2 .2", "0 1.1 .5 .2 .2", "0 .5 .5 0 .2", "0 inf .5 .2 .2"]
    out = parse_label_lines(spark.createDataFrame([(x,) for x in lines], "line string"), "line", 2)
    found = {r.line: r.error for r in out.collect()}
    assert [found[x] for x in lines[:6]] == ["ok", "fields", "class_text", "class_range", "centre", "size"]
    assert found[lines[6]] != "ok"

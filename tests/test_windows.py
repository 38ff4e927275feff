"""Event-time windows over a replay that comes out of order, and naive time on a day that a zone cuts short."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from pvlens.functions import ordering, scalars
from pvlens.operators import events, features, review
from pvlens.plans import catalogue
from pvlens.streaming import replay, windows

SPRING = dt.datetime(2022, 3, 13, 0, 58)


def series(spark, n=120):
    rows = [(i, 0.9 if 10 <= i < 100 and i % 50 else 0.1) for i in range(n)]
    step = F.expr(f"timestamp_ntz'{SPRING}' + make_dt_interval(0, 0, int(2 * n), 0)")
    return spark.createDataFrame(rows, "n long, anomaly_score double").select("n", step.alias("Timestamp"), "anomaly_score", F.when(F.col("anomaly_score") > 0.5, "ALERT").otherwise("NORMAL").alias("status"))


def facts(spark):
    t = series(spark)
    return {
        "positions": sorted((r.n, r._pos) for r in ordering.positions(t, "Timestamp").collect()),
        "runs": sorted((str(r.start_timestamp), str(r.end_timestamp), r.row_count, r.duration_minutes) for r in events.group_alert_events(t).collect()),
        "by_series": sorted((str(r.start_timestamp), r.row_count) for r in events.group_alert_events(t.withColumn("s", F.lit(1)), by=("s",)).collect()),
        "near": sorted((r.n, r.offset_minutes) for r in review.near_events(t, [SPRING + dt.timedelta(minutes=92)], 20).collect()),
        "parsed": [str(r[0]) for r in spark.createDataFrame([("13-3-2022 2:30",), ("13-03-2022 03:30",), ("31-2-2022 1:00",), ("x",), (None,), ("1-1-22 1:1",)], "t string").select(scalars.parse_timestamp(F.col("t"))).collect()],
        "spike": [tuple(r) for r in review.spike_review(t.withColumn("series", F.lit(1)), "anomaly_score", F.col("n") == 60).collect()],
    }


def test_a_short_day_reads_as_any_other(spark):
    want = facts(spark)
    assert want["positions"] == [(i, i) for i in range(120)]
    assert [r[2:] for r in want["runs"]] == [(40, 80), (49, 98)]
    assert want["parsed"] == ["2022-03-13 02:30:00", "2022-03-13 03:30:00", "None", "None", "None", "None"]
    assert len(want["near"]) == 21
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert facts(spark) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture
def disordered(spark, tmp_path):
    """Four files; rows of one step come up to 40 minutes late."""
    t = series(spark).withColumn("series", F.lit("s")).unionByName(series(spark).where("n % 7 < 5").withColumn("series", F.lit("q")))
    step = F.least(F.floor((F.col("n") + F.pmod(F.hash("n", "series"), F.lit(20))) / 35), F.lit(3))
    folder = str(tmp_path / "in")
    for k in range(4):
        t.where(step == k).orderBy(F.hash("n")).coalesce(1).write.mode("append").parquet(folder)
    return t, folder


def drain(spark, tmp_path, folder, make):
    name = uuid.uuid4().hex
    windows.close_replay(spark, folder)
    stream = replay.read_replay(spark, folder, spark.read.parquet(folder).schema)
    return windows.run_out(make(stream), str(tmp_path / f"out-{name}"), str(tmp_path / f"ck-{name}"))


def test_alert_events_out_of_order(spark, tmp_path, disordered):
    t, folder = disordered
    got = drain(spark, tmp_path, folder, lambda s: windows.alert_events(s, "60 minutes"))
    want = events.group_alert_events(t, by=("series",))
    names = ("series", "start_timestamp", "end_timestamp", "row_count", "maximum_anomaly_score")
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(tuple(r) for r in want.select(*names).collect())
    assert got.count() > 5


def test_tumbling_sliding_and_session_windows(spark, tmp_path, disordered):
    t, folder = disordered
    n, top = F.count("anomaly_score").alias("n"), F.max("anomaly_score").alias("top")
    for slide in (None, "10 minutes"):
        got = drain(spark, tmp_path, folder, lambda s: windows.windowed(s, "Timestamp", "60 minutes", "30 minutes", slide, ["series"], [n, top]))
        want = t.groupBy("series", F.window("Timestamp", "30 minutes", slide)).agg(n, top).select("series", "window.start", "window.end", "n", "top")
        assert sorted(map(tuple, got.where("series is not null").collect())) == sorted(map(tuple, want.collect()))
    got = drain(spark, tmp_path, folder, lambda s: windows.sessions(s, "Timestamp", "60 minutes", "3 minutes", ["series"], [n, top]))
    want = t.groupBy("series", F.session_window("Timestamp", "3 minutes")).agg(n, top).select("series", "session_window.start", "session_window.end", "n", "top")
    assert sorted(map(tuple, got.where("series is not null").collect())) == sorted(map(tuple, want.collect()))


def test_rows_beyond_the_delay_are_dropped(spark, tmp_path):
    t, folder = series(spark).withColumn("series", F.lit("s")), str(tmp_path / "in")
    for part in ("n <> 3 and n < 100", "n >= 100", "n = 3"):  # what is late is known a step after
        t.where(part).coalesce(1).write.mode("append").parquet(folder)
    got = drain(spark, tmp_path, folder, lambda s: windows.windowed(s, "Timestamp", "1 minute", "10 minutes", None, ["series"], [F.count("*").alias("n")]))
    assert sum(r.n for r in got.where("series is not null").collect()) == 119

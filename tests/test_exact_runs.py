"""Alert events of a stream whose rows do not all lie on one grid of the cadence."""

from pyspark.sql import functions as F

from pvlens.operators import events
from pvlens.streaming import replay, windows


def test_runs_on_several_grids(spark, tmp_path):
    seconds = {"a": [0, 120, 240, 361, 481, 600, 720, 960], "b": [0, 120, 180, 240, 300, 420, 541]}
    rows = [(s, at, float(i)) for s, times in seconds.items() for i, at in enumerate(times)]
    stamp = F.expr("timestamp_ntz'2022-03-13 01:58:00' + make_dt_interval(0, 0, 0, at)")
    t = spark.createDataFrame(rows, "series string, at int, anomaly_score double").select("series", stamp.alias("Timestamp"), "anomaly_score", F.lit("ALERT").alias("status"))
    folder = str(tmp_path / "in")
    for k in (1, 0):  # the odd rows come first
        t.where(F.col("anomaly_score") % 2 == k).coalesce(1).write.parquet(folder, mode="append")
    windows.close_replay(spark, folder)
    found = windows.alert_events(replay.read_replay(spark, folder, t.schema), "60 minutes")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Pandas" not in plan and "Python" not in plan  # state is kept by Spark, without a call of Python for each series
    got = windows.run_out(found, str(tmp_path / "out"), str(tmp_path / "state"))
    runs = sorted((r.series, r.start_timestamp.minute * 60 + r.start_timestamp.second, r.row_count, r.maximum_anomaly_score, r.mean_anomaly_score) for r in got.collect())
    at = lambda second: (58 * 60 + second) % 3600
    want = [("a", at(0), 3, 2.0, 1.0), ("a", at(361), 2, 4.0, 3.5), ("a", at(600), 2, 6.0, 5.5), ("a", at(960), 1, 7.0, 7.0), ("b", at(0), 3, 3.0, 4 / 3), ("b", at(180), 3, 5.0, 11 / 3), ("b", at(541), 1, 6.0, 6.0)]
    assert runs == sorted(want)
    assert events.group_alert_events(t.where("series = 'a'"), by=("series",)).count() == 4

"""Mergeable sketches, a predictor of one's own, and partitions by time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvlens.operators import predictor, sketches
from pvlens.plans import stages


def test_sketches_merge(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 6, float(v), None) for i, v in enumerate(rng.exponential(size=6000))] + [(6, float("nan"), None), (7, None, None)]
    df = spark.createDataFrame(rows, "f int, x double, y double")
    found = {r.column_name: r for r in sketches.answers(sketches.merged(sketches.states(df, ["x", "y"], ["f"])), {"p10": 0.1, "p90": 0.9}).collect()}
    x = np.sort([r[1] for r in rows[:6000]])
    r = found["x"]
    assert (r.n, r.missing, r.minimum, r.maximum) == (6000, 2, x[0], x[-1]) and abs(r["mean"] - x.mean()) < 1e-9
    for p, v in ((0.1, r.p10), (0.9, r.p90)):
        assert abs(np.searchsorted(x, v) / 6000 - p) <= sketches.RANK_ERROR
    assert abs(r.distinct / 6000 - 1) <= sketches.DISTINCT_ERROR
    assert (found["y"].n, found["y"].missing, found["y"].p10, found["y"].distinct) == (0, 6002, None, 0)


def test_predictor(spark):
    rows = [(s, n, float(n)) for s in ("a", "b") for n in range(10)]
    spark.createDataFrame(rows[::-1], "series string, n long, x double").createOrReplaceTempView("predicted")
    seen = "SELECT * FROM plain_predictor(TABLE(predicted) PARTITION BY series ORDER BY n)"
    predictor.register(spark, "plain_predictor", lambda x: [None if v == 8 else v + 1 for v in x["x"]], ["x"], stride=4, batch=3)
    got = sorted(map(tuple, spark.sql(seen).collect()))
    assert got == [(s, n, n % 4 == 0, n // 4 + 1, float(n + 1) if n in (0, 4) else None) for s in ("a", "b") for n in range(10)]
    with pytest.raises(ValueError):
        predictor.predictor(len, [], stride=0)


def test_partitions_by_time(spark, tmp_path):
    step = F.expr("timestamp_ntz'2022-04-27 00:00:00' + make_dt_interval(0, 0, int(2 * id), 0)")
    df = spark.range(10).select(step.alias("Timestamp"), "id")
    bounds = [("training", "2022-04-27 00:00:00", "2022-04-27 00:08:00"), ("evaluation", "2022-04-27 00:10:00", "2022-04-27 00:18:00")]
    got = stages.split_by_time(df, bounds, str(tmp_path / "ok"), rows={"training": 5, "evaluation": 5})
    assert {(r.id, r.partition) for r in got.collect()} == {(i, "training" if i < 5 else "evaluation") for i in range(10)}
    late = [bounds[0], ("evaluation", "2022-04-27 00:10:00", "2022-04-27 00:19:00")]
    hole = [bounds[0], ("evaluation", "2022-04-27 00:12:00", "2022-04-27 00:18:00")]
    for wrong, rows, table, said in ((late, {}, df, "evaluation.last"), (hole, {}, df, "in_no_partition = 1"), (bounds, {"training": 4}, df, "training.rows = 5"), (bounds, {}, df.union(df.where("id = 3")), "repeated_timestamp = 1")):
        with pytest.raises(ValueError, match=said):
            stages.split_by_time(table, wrong, str(tmp_path / "bad"), rows=rows)
    with pytest.raises(ValueError, match="begins before"):
        stages.split_by_time(df, bounds[::-1], str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()

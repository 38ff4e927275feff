"""The forest as expressions and as boxes against its Arrow scoring, on a fitted forest of 300 trees."""

import math

import numpy as np
import pytest

from pvlens.operators import iforest


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(3).normal(size=(400, 4)).round(2)
    x[7] = 9.0
    data = [(i, *map(float, r)) for i, r in enumerate(x)] + [(400, None, 1.0, 1.0, 1.0), (401, math.nan, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double").cache()


def test_expressions_equal_batches(spark, rows):
    names = ["a", "b", "c", "d"]
    forest = iforest.fit(rows.where("id < 400"), names, "id")
    assert forest["tree"].nunique() == 300
    want = {r.id: r.anomaly_score for r in iforest.score(rows, forest, names).collect()}
    scored = iforest.score_sql(rows, forest, names, with_boxes=True)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
    got = {r.id: (r.anomaly_score, r.inside) for r in scored.collect()}
    assert got.keys() == want.keys() and got[400][0] is None and got[401][0] is None
    for i in range(400):
        assert abs(got[i][0] - want[i]) < 1e-12 and got[i][1] == 300
    assert max(want, key=lambda i: want[i] or 0) == 7


def test_boxes_part_the_space(spark, rows):
    names = ["a", "b", "c", "d"]
    forest = iforest.fit(rows.where("id < 400"), names, "id", trees=5, sample=64)
    found = iforest.boxes(forest)
    x = np.random.default_rng(4).normal(size=(200, 4)) * 2
    for _, own in found.groupby("tree"):
        hits = np.zeros(len(x), int)
        for bounds in own["bounds"]:
            hits += np.all([(x[:, f] > lo) & (x[:, f] <= hi) for f, lo, hi in bounds] or [np.ones(len(x), bool)], axis=0)
        assert (hits == 1).all()

"""Interval joins against all pairs, with long and short intervals, gaps, groups, nulls and a hot cell."""

import random

import pytest

from pvlens.operators import intervals


def tables(spark, seed):
    rng = random.Random(seed)
    def rows(n):
        out = []
        for i in range(n):
            lo = rng.randrange(-500, 5000)
            out.append((i, rng.choice(["a", "b", None]), lo, lo + rng.choice([0, 1, 3, 40, 900, 6000])))
        return [*out, (n, "a", None, 4), (n + 1, "a", 9, 2), (n + 2, "b", 100, 100), (n + 3, "b", 100, 100)]
    a, b = rows(120), rows(90)
    schema = "id long, g string, lo long, hi long"
    return a, b, spark.createDataFrame(a, schema), spark.createDataFrame([(x[0], *x[1:]) for x in b], "rid long, g string, lo long, hi long")


def whole(r):
    return r[2] is not None and r[2] <= r[3]


@pytest.mark.parametrize("gap, unit, most", [(0, 1, 1 << 16), (10, 8, 4), (1, 100, 1 << 16)])
def test_pairs(spark, gap, unit, most):
    a, b, left, right = tables(spark, gap)
    meet = lambda x, y: whole(x) and whole(y) and x[2] - max(0, gap - 1) <= y[3] and y[2] <= x[3] + max(0, gap - 1)
    got = intervals.overlaps(left, right, ("lo", "hi"), ("lo", "hi"), ("id", "rid"), ["g"], gap, unit, most)
    rows = [(r.g, r.id, r.rid) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(x[1], x[0], y[0]) for x in a for y in b if x[1] == y[1] and meet(x, y)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    far = intervals.apart(left, right, ("lo", "hi"), ("lo", "hi"), ("id", "rid"), ["g"], gap, unit)
    assert {r.id for r in far.collect()} == {x[0] for x in a if not any(x[1] == y[1] and meet(x, y) for y in b)}


def test_points(spark):
    a, b, left, right = tables(spark, 5)
    got = intervals.within(left.where("lo is not null"), right, "lo", ("lo", "hi"), ("id", "rid"), unit=16)
    assert {(r.id, r.rid) for r in got.collect()} == {(x[0], y[0]) for x in a for y in b if x[2] is not None and whole(y) and y[2] <= x[2] <= y[3]}
    assert intervals.within(left.limit(0), right, "lo", ("lo", "hi"), ("id", "rid")).count() == 0

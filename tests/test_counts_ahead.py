"""Rows within a span after each time, against all pairs; interval pairs that are found once."""

import random

from pyspark.sql import functions as F

from pvlens.functions import ordering
from pvlens.operators import intervals


def test_counts_ahead(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-250, 250)])) for _ in range(700)]
    got = ordering.counts_ahead(spark.createDataFrame(rows, "g string, us long"), "us", 40, ["g"]).collect()
    want = {(g, t): sum(h == g and u is not None and t <= u <= t + 40 for h, u in rows) for g, t in rows if t is not None}
    assert len(got) == len(want) and {(r.g, r.us): r.n for r in got} == want


def test_interval_pairs_need_no_distinct(spark):
    """The pairs are not shuffled to find those that came twice."""
    rows = [(i, i % 3, 7 * i, 7 * i + i % 90) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g long, lo long, hi long")
    met = intervals.overlaps(df, df.withColumnRenamed("id", "rid"), ("lo", "hi"), ("lo", "hi"), ("id", "rid"), ["g"], unit=4, most=8)
    got = [(r.id, r.rid) for r in met.select("id", "rid").collect()]
    assert len(got) == len(set(got)) and set(got) == {(x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]}
    plan = met._jdf.queryExecution().analyzed().toString()
    assert "Distinct" not in plan and met.agg(F.count("*")).first()[0] == len(got)

"""One-scan correlations against numpy, with missing cells, large means, constants and an empty table."""

import numpy as np
from pyspark.sql import functions as F

from pvlens.operators import gram, review


def test_pairs_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 7))
    x[:, 1] = x[:, 0] * 2 + 1e9
    x[:, 2] = 4.25
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 6] = np.nan
    x[5, 6] = 1.0
    names = [f"c{i}" for i in range(7)]
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(r)) for r in x] + [(float("inf"),) * 7]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    for fan_in in (2, 32):
        got = {(r.a, r.b): (r.n, r.r, r.strong) for r in gram.correlations(df, names, 0.95, fan_in).collect()}
        assert len(got) == 21
        for i in range(7):
            for j in range(i + 1, 7):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                n, r, strong = got[names[i], names[j]]
                assert n == both.sum()
                if 2 in (i, j) or n < 2:
                    assert r is None and not strong
                else:
                    assert abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-6 and strong == (abs(r) >= 0.95)


def test_one_scan_and_empty(spark):
    df = spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.lit("x").alias("_part"))
    found = review.correlations(df, ["a", "b"])
    assert [(r.n, round(r.r, 9), r.strong) for r in found.collect()] == [(100, 1.0, True)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    assert [(r.n, r.r) for r in review.correlations(df.limit(0), ["a", "b"]).collect()] in ([], [(0, None)])


def test_focused_groups(spark):
    pairs = spark.createDataFrame([("a", "b", 9, -0.5, False), ("a", "c", 9, 0.2, False), ("b", "c", 9, None, False)], "a string, b string, n long, r double, strong boolean")
    got = {r.name: (r.pairs, r.minimum, r.maximum) for r in review.focused_groups(pairs, {"g": ["a", "b", "c"], "h": ["a", "c"]}).collect()}
    assert got == {"g": (3, 0.2, 0.5), "h": (1, 0.2, 0.2)}

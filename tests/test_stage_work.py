"""The work of the feature stages and their validators: few wide frames, one scan, the same cells as frames added up row by row."""

import math
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pvlens import schema as S
from pvlens.functions.scalars import column_stats, row_stats
from pvlens.functions.windows import full
from pvlens.operators import features, review

_AGG = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    """Series of 70, 40, 31 and 3 rows, one of them null: holes, a NaN, constant stretches."""
    rows = []
    for series, n in ((1, 70), (2, 40), (None, 31), (3, 3)):
        for i in range(n):
            power = None if series == 1 and i == 33 else math.nan if series == 2 and i == 35 else 0.1 if series is None else (i * 7919 % 1013) / 7
            sun = None if series == 2 and i % 17 == 16 else 1e6 + (i * 31 % 17) / 3
            at = datetime(2022, 1, 1) + timedelta(minutes=2 * i)
            rows.append((series, i, at, 20 + i / 3, 80 - i / 7, i / 10, 1.0, sun, *((i * k % 5) / 3 if i != 9 else None for k in range(1, 6)), 30.0, 5.0, power))
    schema = "series int, n int, Timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in S.MEASUREMENTS)
    return spark.createDataFrame(rows, schema).repartition(3)


def test_rolling_equals_frames_added_up(odd):
    basic = features.add_basic(odd, "series")
    w = Window.partitionBy("series").orderBy("n")
    want = basic.select("series", "n", *(full(_AGG[s](c), F.col(c), n, w).alias(f"{c.lower()}_roll_{s}_{label}") for c, s, n, label in S.ROLLING_SPECS))
    have = {(r["series"], r["n"]): r for r in features.add_rolling(basic, "series").collect()}
    for r in want.collect():
        for c in S.ROLLING:
            x, y = have[r["series"], r["n"]][c], r[c]
            assert (x is None) == (y is None), (r["series"], r["n"], c)
            assert "_mean_" not in c or y is None or x == y or math.isnan(x)
            assert y is None or (math.isnan(x) and math.isnan(y)) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (r["series"], r["n"], c)
    assert all(have[None, i]["power_generated_roll_std_60m"] == 0 for i in (29, 30))


def test_stage_reads_once_and_wide_frames_hold_sums_alone(odd):
    plan = plan_of(features.add_rolling(features.add_basic(odd, "series"), "series"))
    assert plan.count("Scan ExistingRDD") == 1
    wide = re.findall(r"(\w+)\([^()]*\) windowspecdefinition\([^()]*(?:\([^()]*\))?[^()]*specifiedwindowframe\(RowFrame, -(?:14|29)", plan)
    assert wide and set(wide) == {"sum"}


def test_column_stats_equal_row_stats(odd):
    cells = lambda s: [F.coalesce(s[k].cast("string"), F.lit("-")) for k in ("mean", "std", "min", "max", "range")]
    differ = odd.where(F.array(*cells(column_stats(S.RTDS))) != F.array(*cells(row_stats(F.array(*S.RTDS)))))
    assert differ.count() == 0


def listed(df):
    """The two counts of `validate_rolling` from a list of rows for every row and window."""
    value, null = F.lit(False), F.lit(False)
    lists = {(c, n): F.collect_list(c).over(Window.partitionBy("series").orderBy("n").rowsBetween(-(n - 1), 0)).alias(f"_{c}_{n}") for c, _, n, _ in S.ROLLING_SPECS}
    for c, s, n, label in S.ROLLING_SPECS:
        held, cell = F.col(f"_{c}_{n}"), F.col(f"{c.lower()}_roll_{s}_{label}")
        mean = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / n
        again = {"mean": mean, "std": F.sqrt(F.aggregate(held, F.lit(0.0), lambda a, x: a + (x - mean) ** 2) / n), "min": F.array_min(held), "max": F.array_max(held)}[s]  # noqa: B023
        whole = F.size(held) == n
        value, null = value | (whole & ~review.close(cell, again, 1e-9, 1e-6)), null | (whole != cell.isNotNull())
    return review.violations(df.select("*", *lists.values()), {"value_differs": value, "null_outside_warm_up": null})


def test_validator_counts_what_lists_of_rows_count(spark, odd):
    good = features.features(odd, "series").persist()
    a, b, c = "power_generated_roll_mean_10m", "rtd_mean_roll_std_30m", "solar_radiation_roll_min_60m"
    harmed = good.withColumns({a: F.when(F.col("n") % 9 == 8, F.col(a) + 1).when(F.col("n") % 9 == 7, F.lit(math.nan)).otherwise(F.col(a)), b: F.when(F.col("n") % 11 != 5, F.col(b)), c: F.when(F.col("n") == 2, 1.0).when(F.col("n") == 38, 1e9).otherwise(F.col(c))})
    for df in (good, harmed):
        found = {r["check"]: r["violations"] for r in review.validate_rolling(df).collect()}
        assert {k: found[k] for k in ("value_differs", "null_outside_warm_up")} == {r["check"]: r["violations"] for r in listed(df).collect()}
        assert found["statistics_out_of_order"] == 0 if df is good else found["statistics_out_of_order"] > 0
    assert found["value_differs"] > 5 and found["null_outside_warm_up"] > 5
    assert "collect_list" not in plan_of(review.validate_rolling(good))
    empty = {r["check"]: r["violations"] for r in review.validate_rolling(good.where("n < 0")).collect()}
    assert set(empty.values()) == {0} and len(empty) == 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:  # windows reach over many batches
        assert {r["check"]: r["violations"] for r in review.validate_rolling(harmed).collect()} == found
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        good.unpersist()


def test_endless_changes_are_counted_once_a_row(odd):
    good = features.features(odd, "series")
    bad = good.withColumns({"air_temp_diff": F.when(F.col("n") == 4, F.lit(math.inf)).otherwise(F.col("air_temp_diff")), "array_voltage_diff": F.when(F.col("n").isin(4, 5), F.lit(-math.inf)).otherwise(F.col("array_voltage_diff"))})
    count = lambda df: {r["check"]: r["violations"] for r in review.validate_change(df).collect()}["not_finite"]
    each = F.lit(False)
    for c in S.CHANGE:
        each = each | (F.col(c).isNotNull() & (F.isnan(c) | (F.abs(c) == math.inf)))
    assert count(good) == good.where(each).count() and count(bad) == bad.where(each).count() == count(good) + 6

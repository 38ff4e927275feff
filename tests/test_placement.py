import datetime as dt
import zlib

from pyspark.sql import functions as F

from pvlens.operators import placement, synthetic

START = dt.datetime(2022, 5, 1)
PLAN = [
    synthetic.Scenario("drop", ("Power_Generated",), (4, 6), (0.2, 0.4), "lower"), synthetic.Scenario("slope", ("Power_Generated",), (5, 5), (0.5, 0.5), "fade"),
    synthetic.Scenario("never", ("Power_Generated",), (3, 3), (0.5, 0.5), "raise"), synthetic.Scenario("still", ("Power_Generated",), (2, 2), (0.0, 0.0), "raise"),
    synthetic.Scenario("sensor", ("Air_Temp", "Power_Generated"), (2, 3), {"Air_Temp": (4.0, 8.0), "Power_Generated": (30.0, 50.0)}, "offset"),
]


def many(spark, lengths):
    rows = [(k, p, START + dt.timedelta(minutes=2 * p), 100.0 + p % 9, 20.0, f"{k}!") for k, n in lengths.items() for p in range(n)]
    return spark.createDataFrame(rows, "s string, _pos long, Timestamp timestamp_ntz, Power_Generated double, Air_Temp double, _room string")


def conditions():
    return {s.name: F.lit(s.name != "never") & (F.col("Power_Generated") != 104) for s in PLAN if s.name != "slope"} | {"slope": F.col("Power_Generated") > 101}


def test_all_series_equal_each_alone(spark):
    """Long, short, one-row and null-keyed series; chunks of 32 rows; a column whose name clashes."""
    df = many(spark, {"a": 400, "b": 90, "d": 1, None: 260}).repartition(5).persist()
    forbidden = F.col("_pos").isin(40, 120)
    options = {"share": 0.06, "gap_rows": 10}
    events, skipped = placement.place_all(df, PLAN, conditions(), forbidden, 7, ["s"], chunk=32, **options)
    got = {k: ([], []) for k in ("a", "b", "d", None)}
    for which, table, order in ((0, events, "event_id"), (1, skipped, "reason")):
        for r in table.orderBy("s", order).collect():
            one = r.asDict()
            got[one.pop("s")][which].append(one)
    for k, (found, passed) in got.items():
        word = zlib.crc32(("{}" if k is None else f'{{"s":"{k}"}}').encode())
        alone = synthetic.place(df.where(F.col("s").eqNullSafe(F.lit(k))), PLAN, conditions(), forbidden, [7, word], **options)
        assert found == alone[0] and sorted(passed, key=str) == sorted(({"scenario": x["scenario"], "reason": x["reason"], "severity": x["severity"]} for x in alone[1]), key=str), k
    assert len(got["a"][0]) == 3 and got["a"][0] != got[None][0] and {x["reason"] for x in got["d"][1]} == {"budget"}


def test_injection_of_many_series(spark):
    df = many(spark, {"a": 120, None: 120}).persist()
    events, _ = placement.place_all(df, PLAN[:2], conditions(), F.lit(False), 3, ["s"], share=0.2, gap_rows=4)
    out = placement.inject_all(df, events, PLAN[:2], ["s"])
    assert out.columns[: len(df.columns)] == df.columns and out.count() == 240
    for k in ("a", None):
        own = F.col("s").eqNullSafe(F.lit(k))
        alone = synthetic.inject(df.where(own), [r.asDict() for r in events.where(own).collect()], PLAN[:2])
        assert out.where(own).orderBy("_pos").collect() == alone.orderBy("_pos").collect()
        assert alone.where("synthetic_anomaly = 1").count() >= 9


def test_no_rows_no_events(spark):
    events, skipped = placement.place_all(many(spark, {"a": 3}).limit(0), PLAN, conditions(), F.lit(False), 7, ["s"])
    assert events.isEmpty() and skipped.isEmpty() and events.columns == ["s", "event_id", "scenario", "start", "n_rows", "severity", "columns"]


def test_jobs_do_not_grow_with_series(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(n, tag):
        df = many(spark, {f"k{i}": 80 for i in range(n)})
        spark.sparkContext.setJobGroup(tag, tag)
        placement.place_all(df, PLAN[:2], conditions(), F.lit(False), 7, ["s"], share=0.2)
        found = len(tracker.getJobIdsForGroup(tag))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    assert jobs(1, "one") == jobs(7, "seven")


def test_near_zero_review(spark):
    """A floor that holds, a null without cause, a ratio that should not be; null keys; one series without a key."""
    was = [("a", i, 10.0, 0.0 if i else None, 0) for i in range(5)] + [(None, i, 10.0, 0.0 if i else None, 0) for i in range(3)]
    now = [("a", 0, 10.0, None, 0), ("a", 1, 0.5, -0.95, 1), ("a", 2, 0.2, None, 1), ("a", 3, 10.0, None, 0), ("a", 4, 10.0, 0.0, 0), (None, 0, 0.5, None, 1), (None, 1, 10.0, float("inf"), 0), (None, 2, 10.0, None, 0)]
    schema = "s string, _pos long, p double, r double, synthetic_anomaly int"
    base, copy = spark.createDataFrame(was, schema), spark.createDataFrame(now, schema)
    rows = synthetic.near_zero_rows(base, copy, "r", "p", 1.0, ["s"]).orderBy("s", "_pos").collect()
    assert [tuple(r) for r in rows] == [(None, 2, 10.0, 10.0, 0, False), ("a", 2, 0.5, 0.2, 1, True), ("a", 3, 0.2, 10.0, 0, True)]
    got = {r.s: tuple(r)[1:] for r in synthetic.near_zero_review(base, copy, "r", "p", 1.0, ["s"]).collect()}
    assert got == {"a": (1, 3, 2, 0, 0, 0, True), None: (1, 2, 1, 1, 1, 1, False)}
    alone = synthetic.near_zero_review(base.where("s = 'a'"), copy.where("s = 'a'"), "r", "p", 1.0).first()
    assert tuple(alone) == (1, 3, 2, 0, 0, 0, True)

import re

import pytest
from pyspark.sql import functions as F

from pvlens.functions import ordering
from pvlens.functions.scalars import parse_timestamp
from pvlens.operators import freeze, preprocess
from pvlens.sources import operational

NUMERIC = ["x", "y"]
RAW = ["Timestamp,x,y,note", "2-5-2022 0:04,3,5,c", "2-5-2022 0:00,1,7,a", "2-5-2022 0:02,,6,", "2-5-2022 0:04,3,5,c", "bad,9,oops,d", "2-5-2022 0:02,4,6,b"]


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    (folder / "a.csv").write_text("\n".join(RAW) + "\n")
    raw = operational.read_text_columns(spark, str(folder)).drop("_file").persist()
    rows = operational.load(spark, str(folder), numeric=NUMERIC).collect()
    text = [(i, r.Timestamp and str(r.Timestamp), *(None if v is None else repr(v) for v in (r.x, r.y)), r.note) for i, r in enumerate(rows)]
    clean = spark.createDataFrame(text, "_pos long, Timestamp string, x string, y string, note string").persist()
    return folder, raw, clean


def found(raw, clean, **options):
    got = {r.check: r.violations for r in preprocess.validate_cleaned(raw, clean, NUMERIC, ["Timestamp", "x", "y"], **options).collect()}
    assert len(got) == 11
    return {k: n for k, n in got.items() if n}


def test_a_good_result_passes(pair):
    _, raw, clean = pair
    assert found(raw, clean) == {} and clean.count() == 5
    assert found(raw.limit(0), clean.limit(0)) == {}


def test_each_fault_is_found(spark, pair, tmp_path):
    folder, raw, clean = pair
    here = lambda *places: F.col("_pos").isin(*places)
    assert found(raw, clean.where("_pos < 4")) == {"row_count_differs": 1, "parse_failures_differ": 1, "ranges_differ": 1, "content_differs": 1}
    assert found(raw, clean.drop("note")) == {"columns_lost": 1, "column_order_differs": 1}
    assert found(raw, clean.withColumn("more", F.lit("1")).select("_pos", "x", "Timestamp", "y", "note", "more")) == {"columns_added": 1, "column_order_differs": 1}
    assert found(raw, clean.drop("y")) == {"columns_lost": 1, "required_columns_missing": 1, "column_order_differs": 1, "ranges_differ": 1, "content_differs": 1}
    assert set(found(raw, clean.drop("Timestamp"))) == {"columns_lost", "required_columns_missing", "column_order_differs", "parse_failures_differ", "bad_timestamp_before_a_good_one", "content_differs"}
    assert found(raw, clean.withColumn("_pos", F.when(here(0), 1).when(here(1), 0).otherwise(F.col("_pos")))) == {"timestamp_steps_back": 1, "content_differs": 2}
    assert found(raw, clean.withColumn("_pos", F.when(here(4), 0).otherwise(F.col("_pos") + 1))) == {"bad_timestamp_before_a_good_one": 1, "content_differs": 5}
    assert found(raw, clean.withColumn("x", F.when(here(0), "1.0000000000001").otherwise(F.col("x")))) == {}
    assert found(raw, clean.withColumn("x", F.when(here(2), "4.5").otherwise(F.col("x")))) == {"content_differs": 1}
    assert found(raw, clean.withColumn("note", F.when(here(2), "z").otherwise(F.col("note")))) == {"content_differs": 1}
    freeze.snapshot(spark, [str(folder)]).write.parquet(str(tmp_path / "before"))
    (folder / "a.csv").write_text("\n".join(RAW[:-1]) + "\n")
    assert found(raw, clean, before=spark.read.parquet(str(tmp_path / "before")), after=freeze.snapshot(spark, [str(folder)])) == {"raw_file_changed": 1}


def test_steps_back_across_chunks_and_gaps(spark):
    values = [1, 5, None, None, 4, 5, 9, None, 8, 9, 2]
    df = spark.createDataFrame(list(enumerate(values)), "_pos long, v int")
    assert preprocess.backward_steps(df, "v", size=3).first().n == 3


def test_both_sides_are_parsed_once_for_all_checks(pair):
    _, raw, clean = pair
    plan = preprocess.validate_cleaned(raw, clean, NUMERIC, ["Timestamp", "x", "y"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp" not in plan and "row_number() windowspecdefinition(Timestamp" not in plan


def test_bounds_meet_a_column_and_no_expression(spark):
    t = spark.sql("SELECT id, timestamp_ntz'2022-01-01 00:00:00' + make_dt_interval(0, 0, int(id % 50), 0) AS at FROM range(1000)")
    plan = ordering.positions(t, "at", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    inside = re.findall(r"lambdafunction\((.{0,160})", plan)
    assert inside and not any("cast" in x.split(", lambda b")[0] or " - " in x.split(", lambda b")[0] for x in inside)
    assert [r[0] for r in ordering.positions(t, "at", ["id"]).orderBy("at", "id").select("_pos").collect()] == list(range(1000))


def test_timestamps_that_fit_and_do_not(spark):
    texts = ["1-2-2022 3:04", "01-02-2022 03:04\n", "1-2-2022 3:04 ", "1-2-2022", "31-2-2022 1:00", "1 2 2022 3 4", "", None, "1-2-22 3:04", "1-2-2022 24:00"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r[0] and str(r[0]) for r in t.select(parse_timestamp(F.col("t"))).collect()]
    assert got == ["2022-02-01 03:04:00"] * 2 + [None] * 8
    run = t.limit(1).select(parse_timestamp(F.lit("20220201 030405"), "yyyyMMdd HHmmss")).first()[0]
    assert str(run) == "2022-02-01 03:04:05"

"""Contracts checked by the writing job, files that appear whole, and bytes that stay as they are."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from pvlens.sources import publish
from pvlens.sources.publish import Contract

START = dt.datetime(2022, 4, 27)


def table(spark, n=50):
    step = F.expr("timestamp_ntz'2022-04-27 00:00:00' + make_dt_interval(0, 0, int(2 * id), 0)")
    return spark.range(n).select(F.lit("s").alias("series"), step.alias("Timestamp"), (F.col("id") * 1.5).alias("x"))


def test_a_kept_contract_takes_one_job(spark, tmp_path):
    whole = Contract("Timestamp", ["series"], 50, "2022-04-27 00:00:00", "2022-04-27 01:38:00", True, 120, ["x"], {"negative": F.col("x") < 0})
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "publish")
    got = publish.publish(table(spark).repartition(3), str(tmp_path / "out"), whole)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.count() == 50 and got.columns == ["series", "Timestamp", "x"]
    assert os.listdir(tmp_path) == ["out"]
    alone = Contract("Timestamp", (), 50, unique=True, cadence=120)
    assert publish.publish(table(spark).repartition(3), str(tmp_path / "alone"), alone).count() == 50


@pytest.mark.parametrize("change, contract, said", [
    (lambda t: t.where("x > 0"), Contract("Timestamp", rows=50), "rows = 49"),
    (lambda t: t.where("x > 0"), Contract("Timestamp", first="2022-04-27 00:00:00"), "first = 2022-04-27 00:02:00"),
    (lambda t: t.where("x < 70"), Contract("Timestamp", last="2022-04-27 01:38:00"), "last ="),
    (lambda t: t.unionByName(t.where("x = 3.0")), Contract("Timestamp", ["series"], unique=True), "repeated_timestamp = 1"),
    (lambda t: t.where("x <> 30"), Contract("Timestamp", cadence=120), "uneven_timestamp = 1"),
    (lambda t: t.withColumn("x", F.when(F.col("x") != 3, F.col("x"))), Contract(finite=["x"]), "not_finite_x = 1"),
    (lambda t: t.withColumn("Timestamp", F.when(F.col("x") != 3, F.col("Timestamp"))), Contract("Timestamp"), "missing_timestamp = 1"),
    (lambda t: t, Contract(checks={"big": "x > 70"}), "check_big ="),
])
def test_a_broken_contract_publishes_nothing(spark, tmp_path, change, contract, said):
    with pytest.raises(ValueError, match=said):
        publish.publish(change(table(spark)), str(tmp_path / "out"), contract)
    assert os.listdir(tmp_path) == []


def test_an_existing_table_stays(spark, tmp_path):
    path = str(tmp_path / "out")
    publish.publish(table(spark), path, Contract(rows=50))
    with pytest.raises(ValueError):
        publish.publish(table(spark, 9), path, Contract(rows=50), mode="overwrite")
    with pytest.raises(FileExistsError):
        publish.publish(table(spark), path, Contract(rows=50))
    assert spark.read.parquet(path).count() == 50
    assert publish.publish(table(spark, 9), path, Contract(rows=9), mode="overwrite").count() == 9


def test_bytes_stay_and_columns_follow(spark, tmp_path):
    records = [b'time,"a ""b""", c ', b'1, "x,y" ,  0.10 ', b'2,"two\nlines","q"\r', "3,é,\t".encode(), b"4,,"]
    source = tmp_path / "in.csv"
    source.write_bytes(b"\n".join(records) + b"\n")
    new = spark.createDataFrame([(0, 0.1, "p"), (1, 1 / 3, 'say "hi"'), (2, None, None), (3, 2.0, "x,y")], "_pos long, v double, w string")
    lines = publish.read_lines(spark, str(source))
    assert [r.value.encode() for r in lines.orderBy("_pos").collect()] == records
    publish.publish_lines(publish.spliced(lines, new, ["v", "w"]), str(tmp_path / "out.csv"))
    want = [records[0] + b",v,w", records[1] + b",0.10000000000000001,p", records[2][:-1] + b',0.33333333333333331,"say ""hi"""\r', records[3] + b",,", records[4] + b',2,"x,y"']
    assert (tmp_path / "out.csv").read_bytes() == b"\n".join(want) + b"\n"
    with pytest.raises(Exception, match="no partner"):
        publish.publish_lines(publish.spliced(lines, new.where("_pos < 3"), ["v"]), str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes() == b"\n".join(want) + b"\n"

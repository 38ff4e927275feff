import random
import statistics

from pyspark.sql import functions as F

from pvlens.functions import ordering


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_distribution_reads_its_input_once(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, *(float(x) for x in range(50))])) for _ in range(2000)]
    spark.createDataFrame(rows, "g string, x double").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    for by in ([], ["g"]):
        assert scans(ordering.distribution(t, "x", by)) == 1
        assert scans(ordering.percentiles(t, "x", {"m": 0.5}, by)) == 1
    got = {r.g: r.m for r in ordering.percentiles(t, "x", {"m": 0.5}, ["g"]).collect()}
    assert got == {g: statistics.median(x for k, x in rows if k == g and x is not None) for g in "ab"}


def test_blocks_of_counts_are_those_of_values(spark):
    t = spark.range(1000).select((F.col("id") * 7 % 1009).cast("double").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    plain, counted = (ordering.blocked(t, "x", blocks=16, **o).select("x", "_block").orderBy("x").collect() for o in ({}, {"count": "n"}))
    assert plain == counted and len({r["_block"] for r in counted}) == 16

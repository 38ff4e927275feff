"""Context of effects against its SQL, where the power of some rows of the event is 0 and halving it changes nothing."""

import duckdb
from pyspark.sql import functions as F

from pvlens.plans import catalogue, stage_queries


def test_rows_without_power_spread_nothing(spark, tmp_path):
    """Series 1 has no power in row 14, series 2 in none of rows 10 to 14, series 3 in all."""
    idle = {1: {14}, 2: {10, 11, 12, 13, 14}, 3: set()}
    rows = [(5 * (100 * s + n), s, 0.0 if n in idle[s] else 50.0 + n % 7) for s in idle for n in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    df.select("*", F.lit("view").alias("event_type"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(event_id), 0)").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.series, r.n): r.context for r in stage_queries.effect_context(spark, str(tmp_path)).collect()}
    assert [got[1, n] for n in (10, 14, 15, 28, 29, 42, 43)] == ["direct", "direct", "propagated", "none", "propagated", "propagated", "none"]
    assert {got[2, n] for n in range(15, 60)} == {"none"} and got[3, 43] == "propagated" and got[3, 44] == "none"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT series, n, context FROM ({catalogue.oracle_sql()['effect_context']})").fetchall()
    assert {(s, n): c for s, n, c in want} == got

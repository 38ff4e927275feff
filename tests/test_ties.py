"""Queries whose order had ties: rows that agree in all but their number, written last number first."""

from pyspark.sql import functions as F

from pvlens.plans import vision_queries


def test_detections_that_tie_are_numbered_by_frame(spark, tmp_path):
    """Every 700th event has the same corner."""
    rows = [(700 * k, 1, "view", 5.0) for k in reversed(range(40))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = vision_queries.detection_table(spark, str(tmp_path)).orderBy("frame_index").collect()
    assert [(r.frame_index, r.number) for r in got] == [(700 * k, k + 1) for k in range(40)]
    assert spark.read.parquet(str(tmp_path / "events.parquet")).select(F.first("event_id")).first()[0] == 27300

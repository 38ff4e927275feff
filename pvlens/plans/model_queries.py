"""Queries of mergeable sketches, set cover and a predictor of one's own, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import predictor, sketches, vision
from ..sources.folders import working_folder
from .catalogue import query, table
from .telemetry import SQL14, telemetry

_SKETCHED = ("l_quantity", "l_extendedprice", "l_partkey")
_SHARES = {"q05": 0.05, "q50": 0.5, "q95": 0.95}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(CAST(min({c}) AS DOUBLE), 4) AS minimum, round(CAST(max({c}) AS DOUBLE), 4) AS maximum, true AS ranks_within, true AS distinct_within FROM lineitem" for c in _SKETCHED))
def merged_sketches(spark, d):
    """States of eight files, written, merged without the files, and held to the exact ranks and counts."""
    rows = table(spark, d, "lineitem").withColumn("_file", F.pmod(F.col("l_orderkey"), F.lit(8)))
    path = working_folder(spark, "sketches")
    sketches.states(rows, _SKETCHED, ["_file"]).write.parquet(path)
    found = sketches.answers(sketches.merged(spark.read.parquet(path)), _SHARES)
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in _SKETCHED))
    long = rows.select(F.inline(cells)).join(F.broadcast(found.select("column_name", *_SHARES, F.col("distinct").alias("_distinct"))), "column_name")  # three rows
    off = F.lit(0.0)
    for name, p in _SHARES.items():  # the share may lie anywhere among equal values
        below, upto = F.avg((F.col("value") < F.col(name)).cast("double")), F.avg((F.col("value") <= F.col(name)).cast("double"))
        off = F.greatest(off, below - F.lit(p), F.lit(p) - upto)
    checks = long.groupBy("column_name").agg((off <= sketches.RANK_ERROR).alias("ranks_within"), (F.abs(F.first("_distinct") / F.count_distinct("value") - 1) <= sketches.DISTINCT_ERROR).alias("distinct_within"))
    return found.join(checks, "column_name").select("column_name", "n", F.round("minimum", 4).alias("minimum"), F.round("maximum", 4).alias("maximum"), "ranks_within", "distinct_within")


@query("""WITH RECURSIVE s AS (SELECT user_id AS image, list_distinct(list(event_type)) AS c FROM events WHERE event_id % 61 = 0 AND user_id IS NOT NULL GROUP BY user_id),
g AS (SELECT 0 AS place, CAST([] AS VARCHAR[]) AS shown, CAST(NULL AS BIGINT) AS image
 UNION ALL SELECT place + 1, list_distinct(list_concat(shown, best.c)), -best.i
 FROM (SELECT g.place, g.shown, max(struct_pack(f := len(list_filter(s.c, lambda x: NOT list_contains(g.shown, x))), i := -s.image, c := s.c)) AS best FROM g, s WHERE g.place < 4 GROUP BY g.place, g.shown) WHERE best.f > 0 OR place = 0)
SELECT place, image FROM g WHERE place > 0""")
def cover_images(spark, d):
    """Up to four images that together show the most classes."""
    rows = table(spark, d, "events").where("event_id % 61 = 0 and user_id is not null")
    picked = vision.pick_examples(rows.groupBy("user_id").agg(F.collect_set("event_type").alias("classes")), 4, "user_id")  # a handful of types
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(picked)], "place int, image long")


@query(f"SELECT CAST(series AS VARCHAR) AS series, n AS place, n % 3 = 0 AS analysed, n // 3 + 1 AS running, CASE WHEN n % 3 = 0 THEN round(Power_Generated * 0.5 + Air_Temp, 5) + 0.0 END AS score FROM ({SQL14})")
def injected_predictor(spark, d):
    """A formula as the predictor, called from SQL on the ordered rows of each series, every third analysed."""
    predictor.register(spark, "pvlens_predict", lambda x: x["Power_Generated"] * 0.5 + x["Air_Temp"], ["Power_Generated", "Air_Temp"], stride=3)
    rows = telemetry(spark, d).select(F.col("series").cast("string").alias("series"), "n", "Power_Generated", "Air_Temp")
    rows.createOrReplaceTempView("pvlens_predicted")
    found = spark.sql("SELECT * FROM pvlens_predict(TABLE(pvlens_predicted) PARTITION BY series ORDER BY n)")
    return found.withColumn("score", F.round("score", 5) + 0.0)


@query(f"SELECT series, n, CASE WHEN n <= 23 THEN 'training' WHEN n <= 31 THEN 'calibration' ELSE 'evaluation' END AS part FROM ({SQL14}) WHERE n < 40")
def split_by_time(spark, d):
    """Partitions by inclusive times, checked by the job that writes them."""
    from .stages import split_by_time as split

    at = lambda n: f"2022-04-27 {n // 30:02d}:{n % 30 * 2:02d}:00"
    bounds = [("training", at(0), at(23)), ("calibration", at(24), at(31)), ("evaluation", at(32), at(39))]
    return split(telemetry(spark, d).where("n < 40"), bounds, working_folder(spark, "split"), by=["series"], name="part").select("series", "n", "part")

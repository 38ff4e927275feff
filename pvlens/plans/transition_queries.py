"""Queries of the largest steps, of column statistics and of files at a glance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review, transitions
from .catalogue import query, table
from .stage_queries import _round, parted
from .telemetry import PART_SQL, SQL14, telemetry

_SIGNALS = ("Power_Generated", "Solar_Radiation")
_LIGHT = "CASE WHEN Solar_Radiation <= 5 THEN 1 ELSE 0 END"


def _lit(spark, d):
    return telemetry(spark, d).withColumn("low_light_context", (F.col("Solar_Radiation") <= 5).cast("int"))


_STEPS = f"""s AS (SELECT *, Power_Generated - lag(Power_Generated) OVER w AS dp, Solar_Radiation - lag(Solar_Radiation) OVER w AS ds, lag(Power_Generated) OVER w AS bp, lag(Solar_Radiation) OVER w AS bs, lag("Timestamp") OVER w AS bt,
 {_LIGHT} AS light, lag({_LIGHT}) OVER w AS dark FROM ({SQL14}) WINDOW w AS (PARTITION BY series ORDER BY n)),
l AS (SELECT 'Power_Generated' AS signal, series, n, bt, bp AS previous_value, Power_Generated AS "value", dp AS change, ds AS other, dark, light FROM s UNION ALL SELECT 'Solar_Radiation', series, n, bt, bs, Solar_Radiation, ds, dp, dark, light FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY abs(change) DESC, series, n) AS place FROM l WHERE change IS NOT NULL QUALIFY place <= 10)"""


def _top(spark, d):
    return transitions.largest_transitions(_lit(spark, d), _SIGNALS)


@query(f"""WITH {_STEPS} SELECT signal, CAST(place AS BIGINT) AS "rank", series, n, CAST(date_diff('second', TIMESTAMP '1970-01-01', bt) AS BIGINT) AS previous_second, round(previous_value, 5) + 0.0 AS previous_value, round("value", 5) + 0.0 AS "value", round(change, 5) + 0.0 AS change, round(other, 5) + 0.0 AS other_change,
 CAST(dark AS BIGINT) AS previous_context, CAST(light AS BIGINT) AS context, dark <> light AS context_changed FROM t""")
def largest_transitions(spark, d):
    """The ten largest steps of power and of radiation over all series, with the row before and the other signal's step."""
    other = F.element_at(F.map_values("other_changes"), 1)
    out = _top(spark, d).withColumn("other_change", other)
    before = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("previous_ts"))
    return out.select("signal", F.col("rank").cast("long").alias("rank"), "series", "n", before.alias("previous_second"), *_round(("previous_value", "value", "change", "other_change")), *(F.col(c).cast("long").alias(c) for c in ("previous_context", "context")), "context_changed")


@query(f"""WITH {_STEPS} SELECT a.series, a.n, CAST(a.place AS BIGINT) AS first_rank, CAST(b.place AS BIGINT) AS second_rank FROM t a JOIN t b ON a.series = b.series AND a.n = b.n AND a.signal = 'Power_Generated' AND b.signal = 'Solar_Radiation'""")
def shared_transitions(spark, d):
    """Rows that are among the ten largest steps of both signals."""
    got = transitions.shared_transitions(_top(spark, d), *_SIGNALS)
    return got.select("series", "n", *(F.col(c).cast("long").alias(c) for c in ("first_rank", "second_rank")))


@query(f"""WITH {_STEPS} SELECT signal, count(*) AS n, count(CASE WHEN light = 1 THEN 1 END) AS in_low_light, count(CASE WHEN light <> dark THEN 1 END) AS context_changes, round(max(abs(change)), 5) AS largest, round(min(abs(change)), 5) AS smallest FROM t GROUP BY signal""")
def transition_summary(spark, d):
    return transitions.transition_summary(_top(spark, d)).select("signal", "n", "in_low_light", "context_changes", *_round(("largest", "smallest")))


@query(f"WITH {_STEPS} SELECT count(*) AS n, round(corr(dp, ds), 5) AS r FROM s WHERE dp IS NOT NULL AND ds IS NOT NULL")
def step_correlation(spark, d):
    return transitions.step_correlation(telemetry(spark, d), *_SIGNALS).select("n", *_round(("r",)))


_CELLS = {"Power_Generated": "CASE WHEN part <> 'evaluation' OR event_id % 97 <> 0 THEN Power_Generated END", "Wind_Speed": "CASE WHEN part = 'calibration' THEN 3.5 ELSE Wind_Speed END", "RTD_1": "RTD_1"}


@query(f"WITH t AS MATERIALIZED (SELECT *, {PART_SQL} AS part FROM ({SQL14})), c AS (" + " UNION ALL ".join(f"SELECT part, '{c}' AS column_name, CAST({e} AS DOUBLE) AS v FROM t" for c, e in _CELLS.items()) + """)
SELECT part AS partition, column_name, count(*) AS n, count(*) - count(v) AS nan_count, count(v) AS finite_count, round(min(v), 5) + 0.0 AS minimum, round(max(v), 5) + 0.0 AS maximum, round(avg(v), 5) + 0.0 AS mean, round(quantile_cont(v, 0.5), 5) + 0.0 AS median, round(stddev_samp(v), 5) + 0.0 AS std, round(stddev_pop(v), 5) + 0.0 AS std_pop,
 count(v) = count(*) AND var_pop(v) > 0 AS usable FROM c GROUP BY ALL""")
def partition_statistics(spark, d):
    """Columns by partition: one has empty cells in one partition, one is constant in another; only whole columns with spread are usable."""
    t = parted(telemetry(spark, d))
    power = F.when((F.col("partition") != "evaluation") | (F.col("event_id") % 97 != 0), F.col("Power_Generated"))
    wind = F.when(F.col("partition") == "calibration", 3.5).otherwise(F.col("Wind_Speed"))
    got = transitions.column_statistics(t.withColumns({"Power_Generated": power, "Wind_Speed": wind}), list(_CELLS), ["partition"])
    return got.select("partition", "column_name", "n", "nan_count", "finite_count", *_round(("minimum", "maximum", "mean", "median", "std", "std_pop")), "usable")


@query(f"""WITH m AS (SELECT unnest([TIMESTAMP '2022-04-27 00:10:00', TIMESTAMP '2022-04-27 00:40:00']) AS moment), j AS (SELECT series, moment, count(*) AS n FROM ({SQL14}), m WHERE abs(date_diff('minute', moment, "Timestamp")) <= 20 AND event_id % 89 <> 0 GROUP BY ALL)
SELECT strftime(moment, '%H:%M') AS moment, n, count(*) AS series FROM j GROUP BY ALL""")
def window_contract(spark, d):
    """Windows of 20 minutes around two moments, some with rows left out: how many series have how many rows; only 21 make a whole one."""
    near = review.near_events(telemetry(spark, d).where("event_id % 89 <> 0"), ["2022-04-27 00:10:00", "2022-04-27 00:40:00"])
    got = transitions.window_contract(near, by=["series"])
    return got.groupBy(F.date_format("moment", "HH:mm").alias("moment"), "n").agg(F.count("*").alias("series"))


_CELL = {"o_orderstatus": "CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE o_orderstatus END", "o_custkey": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END", "o_shippriority": "CAST(o_orderkey % 4 AS VARCHAR)", "mixed": "CASE WHEN o_orderkey % 1000 = 7 THEN 'n/k' ELSE CAST(o_custkey % 5 AS VARCHAR) END"}


@query(f"WITH r AS (SELECT o_orderpriority AS file, {', '.join(f'{e} AS {c}' for c, e in _CELL.items())} FROM (SELECT DISTINCT o_orderpriority, o_orderkey, o_orderstatus, o_custkey FROM orders)), c AS (" + " UNION ALL ".join(f"SELECT file, {i} AS place, '{c}' AS column_name, CASE WHEN trim({c}) <> '' THEN {c} END AS v FROM r" for i, c in enumerate(_CELL)) + """),
a AS (SELECT file, CAST(sum(k - 1) AS BIGINT) AS duplicate_rows FROM (SELECT {own}, count(*) AS k FROM r GROUP BY ALL) GROUP BY file)
SELECT file, CAST(place AS BIGINT) AS place, column_name, CASE WHEN count(v) = 0 THEN 'empty' WHEN count(v) = count(TRY_CAST(v AS DOUBLE)) THEN 'number' ELSE 'text' END AS kind, count(*) AS n, count(*) - count(v) AS missing, count(DISTINCT v) + CASE WHEN count(v) < count(*) THEN 1 ELSE 0 END AS "distinct",
 CASE WHEN count(v) = count(TRY_CAST(v AS DOUBLE)) THEN min(TRY_CAST(v AS DOUBLE)) END AS lowest, CASE WHEN count(v) = count(TRY_CAST(v AS DOUBLE)) THEN max(TRY_CAST(v AS DOUBLE)) END AS highest, CASE WHEN count(DISTINCT v) <= 10 THEN array_to_string(list_sort(list(DISTINCT v)), ',') END AS "values", any_value(duplicate_rows) AS duplicate_rows
FROM c JOIN a USING (file) GROUP BY ALL""".replace("{own}", ", ".join(["file", *_CELL])))
def file_inspection(spark, d):
    """Orders as text, a file for each priority: what the columns of each file hold."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus", "o_custkey").distinct()
    rows = o.select(F.col("o_orderpriority").alias("_file"), *(F.expr(e.replace("VARCHAR", "STRING")).alias(c) for c, e in _CELL.items()))
    got = transitions.inspect_files(rows)
    return got.select("file", F.col("place").cast("long").alias("place"), "column_name", "kind", "n", "missing", "distinct", "lowest", "highest", F.array_join("values", ",").alias("values"), "duplicate_rows")

"""Queries that place synthetic events on every series of the telemetry table and review what they do, with their SQL.

For a placement each series allows one start for each scenario, so that SQL can say what a draw must find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, placement, synthetic
from .catalogue import query, r6
from .telemetry import SQL14, featured, telemetry

GAP, TAIL, SHARE = 5, 2, 3 / 32
_FIRST = "(5 + series % 7)"
_SECOND = f"({_FIRST} + 6 + series % 5)"

_SQL = f"""WITH t AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY series) AS held, max(CASE WHEN Wind_Speed > 2.8 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY n ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS bad6,
 max(CASE WHEN Wind_Speed > 2.8 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY n ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS bad4 FROM ({SQL14})),
g AS (SELECT series, max(held) AS held, max(held) * 3 // 32 AS budget, max(CASE WHEN n = {_FIRST} AND n + 4 <= held AND bad6 = 0 THEN 1 ELSE 0 END) AS fits1, max(CASE WHEN n = {_SECOND} AND n + 2 <= held AND bad4 = 0 THEN 1 ELSE 0 END) AS fits2 FROM t GROUP BY series),
one AS (SELECT *, CASE WHEN budget < 4 THEN 'budget' WHEN fits1 = 0 THEN 'no_place' END AS why1, budget - CASE WHEN budget >= 4 AND fits1 = 1 THEN 4 ELSE 0 END AS spare FROM g),
two AS (SELECT *, CASE WHEN spare < 2 THEN 'budget' WHEN fits2 = 0 OR (why1 IS NULL AND {_SECOND} < {_FIRST} + 4 + {GAP}) THEN 'no_place' END AS why2 FROM one),
e AS (SELECT series, 'drop' AS scenario, why1 AS reason, CAST(CASE WHEN why1 IS NULL THEN {_FIRST} END AS BIGINT) AS start, CASE WHEN why1 IS NULL THEN 4 END AS n_rows FROM two
 UNION ALL SELECT series, 'warm', why2, CAST(CASE WHEN why2 IS NULL THEN {_SECOND} END AS BIGINT), CASE WHEN why2 IS NULL THEN 2 END FROM two)
"""


def _plan():
    return [synthetic.Scenario("warm", ("Air_Temp",), (2, 2), (0.5, 0.5), "fade"), synthetic.Scenario("drop", ("Power_Generated", "Array_Voltage"), (4, 4), (0.25, 0.25), "lower")]


def _decided(spark, d):
    t = telemetry(spark, d)
    first = 5 + F.pmod("series", F.lit(7))
    second = first + 6 + F.pmod("series", F.lit(5))
    ok = {"drop": F.col("n").between(first, first + 3), "warm": F.col("n").between(second, second + 1)}
    return t, *placement.place_all(t, _plan(), ok, F.col("Wind_Speed") > 2.8, seed=42, by=["series"], share=SHARE, gap_rows=GAP, pos="n", tail=TAIL)


@query(_SQL + "SELECT series, scenario, coalesce(reason, 'placed') AS outcome, coalesce(start, -1) AS start, CAST(coalesce(n_rows, 0) AS INTEGER) AS n_rows FROM e")
def series_placement(spark, d):
    """Which scenarios every series took and where (-1 and 0 rows: nowhere), and why it passed over the others."""
    _, events, skipped = _decided(spark, d)
    rest = skipped.select("series", "scenario", F.col("reason").alias("outcome"), F.lit(-1).cast("long").alias("start"), F.lit(0).alias("n_rows"))
    return events.select("series", "scenario", F.lit("placed").alias("outcome"), "start", "n_rows").unionByName(rest)


@query(_SQL + """SELECT t.series, t.n, CASE WHEN scenario IS NULL THEN 'none' ELSE scenario END AS kind, round(CASE WHEN scenario = 'drop' THEN Power_Generated * 0.75 ELSE Power_Generated END, 6) + 0.0 AS power, round(CASE WHEN scenario = 'drop' THEN Array_Voltage * 0.75 ELSE Array_Voltage END, 6) AS voltage,
round(CASE WHEN scenario = 'warm' THEN Air_Temp * (1 - 0.5 * (t.n - start + 1) / n_rows) ELSE Air_Temp END, 6) AS air FROM t LEFT JOIN e ON t.series = e.series AND t.n >= start AND t.n < start + n_rows""")
def series_injection(spark, d):
    """Every series with its events in it."""
    t, events, _ = _decided(spark, d)
    out = placement.inject_all(t, events, _plan(), ["series"], "n")
    return out.select("series", "n", F.col("synthetic_anomaly_type").alias("kind"), r6("Power_Generated").alias("power"), r6("Array_Voltage").alias("voltage"), r6("Air_Temp").alias("air"))


_RATIOS = f"""WITH m AS (SELECT series, n, Power_Generated AS b, CASE WHEN n BETWEEN 10 AND 14 THEN Power_Generated * 0.001 ELSE Power_Generated END AS s FROM ({SQL14})),
l AS (SELECT *, lag(b) OVER w AS lb, lag(s) OVER w AS ls FROM m WINDOW w AS (PARTITION BY series ORDER BY n)),
r AS (SELECT *, lb IS NULL OR abs(lb) < 1 OR b IS NULL AS none_before, ls IS NULL OR abs(ls) < 1 OR s IS NULL AS none_after FROM l)
"""


def _near_zero(spark, d):
    """Power of a thousandth in rows 10 to 14 of every series, with all 81 columns computed again."""
    t, inside = telemetry(spark, d), F.col("n").between(10, 14)
    hit = t.withColumn("Power_Generated", F.when(inside, F.col("Power_Generated") * 0.001).otherwise(F.col("Power_Generated")))
    again = features.features(hit, "series").withColumn("synthetic_anomaly", inside.cast("int"))
    return featured(spark, d), again, "power_generated_relative_change", "Power_Generated", 1.0, ["series"], "n"


@query(_RATIOS + "SELECT series, n, round(ls, 6) AS previous, round(s, 6) AS current, CASE WHEN n BETWEEN 10 AND 14 THEN 1 ELSE 0 END AS label, abs(ls) < 1 AS explained FROM r WHERE none_after AND NOT none_before")
def near_zero_nulls(spark, d):
    """Ratios that are null because the power before them was brought near zero."""
    return synthetic.near_zero_rows(*_near_zero(spark, d)).withColumns({"previous": r6("previous"), "current": r6("current")})


@query(_RATIOS + """SELECT series, count(CASE WHEN none_before THEN 1 END) AS nulls_before, count(CASE WHEN none_after THEN 1 END) AS nulls_after, count(CASE WHEN none_after AND NOT none_before THEN 1 END) AS additional,
count(CASE WHEN none_after AND NOT none_before AND NOT abs(ls) < 1 THEN 1 END) AS unexplained, CAST(0 AS BIGINT) AS unguarded, CAST(0 AS BIGINT) AS endless, count(CASE WHEN none_after AND NOT none_before AND NOT abs(ls) < 1 THEN 1 END) = 0 AS safe FROM r GROUP BY series""")
def near_zero_safeguard(spark, d):
    """Of each series, whether the floor under its ratios held."""
    return synthetic.near_zero_review(*_near_zero(spark, d))

"""Queries that run the library's stages over the telemetry table made from `events`, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import events, features, profile, review, scores, serving, synthetic
from ..operators.calibration import flag_summary
from .catalogue import query, r6, table
from .telemetry import PART_SQL, SQL14, SQL31, SQL61, SQL81, featured, sql81, telemetry


def parted(df):
    part = F.when(F.col("n") <= 23, "training").when(F.col("n") <= 47, "calibration").otherwise("evaluation")
    return df.withColumn("partition", part)


def _rounded(columns, digits=5):
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def _round(columns, digits=5):
    return [(F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) for c in columns]


# --- feature stages --------------------------------------------------------------------------

_WHOLE = ("hour", "minute", "minute_of_day", "low_light_context")
_BASIC = [c for c in S.BASIC if c not in _WHOLE]


@query(f"SELECT series, n, {', '.join(_WHOLE)}, {_rounded(_BASIC)} FROM ({SQL31})")
def features_basic(spark, d):
    return features.add_basic(telemetry(spark, d), "series").select("series", "n", *(F.col(c).cast("long").alias(c) for c in _WHOLE), *_round(_BASIC))


@query(f"SELECT series, n, {_rounded(S.ROLLING)} FROM ({SQL61})")
def features_rolling(spark, d):
    t = telemetry(spark, d)
    return features.add_rolling(features.add_basic(t, "series"), "series").select("series", "n", *_round(S.ROLLING))


@query(f"SELECT series, n, {_rounded(S.CHANGE)} FROM ({SQL81})")
def features_change(spark, d):
    return featured(spark, d).select("series", "n", *_round(S.CHANGE))


def _inventory_sql():
    def one(c):
        return f"SELECT '{c}' AS column_name, '{review.category_of(c)}' AS category, '{review.recommendation_of(c)}' AS recommendation, count(*) AS n, count(*) - count({c}) AS missing, round(min({c}), 4) + 0.0 AS minimum, round(max({c}), 4) + 0.0 AS maximum, CASE WHEN count(*) = count({c}) THEN 'none' ELSE '{review.mechanism_of(c)}' END AS mechanism FROM t"

    return f"WITH t AS MATERIALIZED ({SQL81}) " + " UNION ALL ".join(one(c) for c in S.S81[1:])


@query(f"SELECT *, CAST(0 AS BIGINT) AS unexplained FROM ({_inventory_sql()})")
def feature_inventory(spark, d):
    """unexplained is 0 where every missing cell has its documented cause; `unexplained_missing` has cells that do not."""
    return review.feature_inventory(featured(spark, d)).select("column_name", "category", "recommendation", "n", "missing", "unexplained", *_round(("minimum", "maximum"), 4), "mechanism")


@query(f"""WITH t AS (SELECT *, CASE WHEN event_id % 40 <> 0 THEN power_generated_roll_mean_10m END AS roll, CASE WHEN event_id % 30 <> 0 THEN air_temp_diff END AS diff FROM ({SQL81}))
SELECT 'power_generated_roll_mean_10m' AS column_name, count(*) - count(roll) AS missing, count(CASE WHEN n >= 4 AND roll IS NULL THEN 1 END) AS unexplained FROM t
UNION ALL SELECT 'air_temp_diff', count(*) - count(diff), count(CASE WHEN n > 0 AND diff IS NULL THEN 1 END) FROM t""")
def unexplained_missing(spark, d):
    """Cells emptied on purpose are missing without a cause."""
    t = featured(spark, d).withColumns({"power_generated_roll_mean_10m": F.when(F.col("event_id") % 40 != 0, F.col("power_generated_roll_mean_10m")), "air_temp_diff": F.when(F.col("event_id") % 30 != 0, F.col("air_temp_diff"))})
    return review.feature_inventory(t, ["power_generated_roll_mean_10m", "air_temp_diff", *review.CORE]).where("unexplained > 0").select("column_name", "missing", "unexplained")


@query(f"WITH t AS MATERIALIZED ({SQL61}) " + " UNION ALL ".join(f"SELECT '{w}' AS width, CAST({len(cs)} AS BIGINT) AS columns, {' + '.join(f'(count(*) - count({c}))' for c in cs)} AS missing FROM t" for w in S.WIDTHS for cs in [[c for c in S.ROLLING if c.endswith(f"_{w}")]]))
def missing_by_width(spark, d):
    return review.missing_by_width(review.feature_inventory(featured(spark, d), S.ROLLING))


@query(f"""WITH t AS MATERIALIZED ({SQL81})
SELECT 'difference_differs' AS "check", count(CASE WHEN n > 0 AND event_id % 50 = 0 THEN 1 END) AS violations FROM t UNION ALL SELECT 'rate_differs', count(CASE WHEN n > 0 AND event_id % 50 = 0 THEN 1 END) FROM t
UNION ALL SELECT 'value_differs', count(CASE WHEN (event_id % 40 = 0 AND rtd_mean_roll_mean_30m IS NOT NULL) OR (event_id % 45 = 0 AND n >= 29) THEN 1 END) FROM t UNION ALL SELECT 'null_outside_warm_up', count(CASE WHEN event_id % 45 = 0 AND n >= 29 THEN 1 END) FROM t
UNION ALL SELECT 'rtd_mean_differs', count(CASE WHEN event_id % 35 = 0 THEN 1 END) FROM t UNION ALL SELECT 'measurements_changed', count(CASE WHEN event_id % 25 = 0 THEN 1 END) FROM t UNION ALL SELECT 'light_flag_differs', count(CASE WHEN event_id % 55 = 0 THEN 1 END) FROM t""")
def validator_mutations(spark, d):
    """Cells broken on purpose: each validator counts exactly those."""
    source, good = telemetry(spark, d), featured(spark, d)
    id_ = F.col("event_id")
    basic = good.withColumns({"rtd_mean": F.when(id_ % 35 == 0, F.col("rtd_mean") + 0.001).otherwise(F.col("rtd_mean")), "Wind_Speed": F.when(id_ % 25 == 0, F.col("Wind_Speed") + 1).otherwise(F.col("Wind_Speed")), "low_light_context": F.when(id_ % 55 == 0, 1 - F.col("low_light_context")).otherwise(F.col("low_light_context"))})
    rolling = good.withColumns({"rtd_mean_roll_mean_30m": F.when(id_ % 40 == 0, F.col("rtd_mean_roll_mean_30m") + 1).otherwise(F.col("rtd_mean_roll_mean_30m")), "air_temp_roll_mean_60m": F.when(id_ % 45 != 0, F.col("air_temp_roll_mean_60m"))})
    change = good.withColumn("array_current_diff", F.when(id_ % 50 == 0, F.col("array_current_diff") + 1).otherwise(F.col("array_current_diff")))
    found = review.validate_basic(source, basic).where("check in ('rtd_mean_differs', 'measurements_changed', 'light_flag_differs')")
    found = found.unionByName(review.validate_rolling(rolling).where("check in ('value_differs', 'null_outside_warm_up')"))
    return found.unionByName(review.validate_change(change).where("check in ('difference_differs', 'rate_differs')"))


# --- profiles -----------------------------------------------------------------------------------

_RULES = {"Air_Temp": "Air_Temp < -273.15", "Relative_Humidity": "Relative_Humidity < 0 OR Relative_Humidity > 100", "Wind_Speed": "Wind_Speed < 0", "Wind_Direction": "Wind_Direction < 0 OR Wind_Direction > 360", "Solar_Radiation": "Solar_Radiation < 0", "Power_Generated": "Power_Generated < 0"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(CASE WHEN {t} THEN 1 END) AS n, round(min(CASE WHEN {t} THEN {c} END), 6) + 0.0 AS lo, round(max(CASE WHEN {t} THEN {c} END), 6) + 0.0 AS hi FROM ({SQL14})" for c, t in _RULES.items()))
def physical_ranges(spark, d):
    return profile.range_flags(telemetry(spark, d)).select("column_name", "n", *_round(("lo", "hi"), 6))


_TEXT_SQL = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'x' || (event_id % 5) WHEN event_id % 11 = 0 THEN 'NA' WHEN event_id % 13 = 0 THEN ' ' ELSE CAST(event_id AS VARCHAR) END AS reading, CASE WHEN event_id % 90 = 0 THEN '1d' ELSE '2.5e1' END AS other FROM events"


def _text(spark, d):
    i = F.col("event_id")
    reading = F.when(i % 7 == 0, F.concat(F.lit("x"), (i % 5).cast("string"))).when(i % 11 == 0, "NA").when(i % 13 == 0, " ").otherwise(i.cast("string"))
    return table(spark, d, "events").select("event_id", reading.alias("reading"), F.when(i % 90 == 0, "1d").otherwise("2.5e1").alias("other"))


@query(f"""WITH t AS ({_TEXT_SQL}), b AS (SELECT 'reading' AS column_name, reading AS text FROM t WHERE reading LIKE 'x%' UNION ALL SELECT 'other', other FROM t WHERE other = '1d')
SELECT column_name, count(*) AS n, array_to_string(list_sort(list(DISTINCT text)), ',') AS examples FROM b GROUP BY column_name""")
def invalid_text(spark, d):
    return profile.invalid_text(_text(spark, d), ["reading", "other"]).select("column_name", "n", F.array_join("examples", ",").alias("examples"))


@query(f"""WITH t AS ({_TEXT_SQL}), s AS (SELECT CASE WHEN trim(reading) IN ('', 'NA') THEN NULL ELSE reading END AS reading, other FROM t)
SELECT 'reading' AS column_name, avg(CASE WHEN reading IS NOT NULL THEN CASE WHEN reading LIKE 'x%' THEN 0 ELSE 1 END END) >= 0.95 AS is_numeric FROM s UNION ALL SELECT 'other', avg(CASE WHEN other = '1d' THEN 0 ELSE 1 END) >= 0.95 FROM s""")
def numeric_columns(spark, d):
    names = ["reading", "other"]
    found = profile.infer_numeric_columns(_text(spark, d), ["event_id"])
    return spark.createDataFrame([(c, c in found) for c in names], "column_name string, is_numeric boolean")


@query(f"""SELECT CAST(CAST("Timestamp" AS DATE) AS VARCHAR) AS day, series, count(*) AS n, count(*) = 720 AS complete FROM ({SQL14}) GROUP BY 1, 2""")
def date_coverage(spark, d):
    return review.date_coverage(telemetry(spark, d), by=["series"]).select(F.col("day").cast("string").alias("day"), "series", "n", "complete")


@query(f"""WITH t AS (SELECT *, coalesce(Solar_Radiation < 0, false) AS low FROM ({SQL14})), r AS (SELECT *, sum(CASE WHEN low IS DISTINCT FROM prev OR n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY n) AS run FROM (SELECT *, lag(low) OVER (PARTITION BY series ORDER BY n) AS prev FROM t)),
k AS (SELECT series, run, count(*) AS k FROM r WHERE low GROUP BY 1, 2)
SELECT count(CASE WHEN low THEN 1 END) AS n, round(count(CASE WHEN low THEN 1 END) * 100.0 / count(*), 6) AS percentage, round(min(CASE WHEN low THEN Solar_Radiation END), 6) AS minimum, round(max(CASE WHEN low THEN Solar_Radiation END), 6) + 0.0 AS maximum, round(quantile_cont(CASE WHEN low THEN Solar_Radiation END, 0.5), 6) AS median, count(DISTINCT CASE WHEN low THEN hour("Timestamp") END) AS hours, (SELECT count(*) FROM k) AS runs, (SELECT max(k) FROM k) AS longest_run FROM t""")
def negative_readings(spark, d):
    found = review.negative_readings(telemetry(spark, d), "Solar_Radiation")
    return found.select("n", *_round(("percentage", "minimum", "maximum", "median"), 6), F.size("hours").cast("long").alias("hours"), "runs", "longest_run")


_PAIRED = ["Air_Temp", "Relative_Humidity", "Solar_Radiation", "rtd_mean", "Array_Current", "Power_Generated", "power_generated_roll_mean_10m"]


@query(f"WITH t AS MATERIALIZED ({SQL61}), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, (avg({a} * {b}) - avg({a}) * avg({b})) / (stddev_pop({a}) * stddev_pop({b})) AS r FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(_PAIRED) for b in _PAIRED[i + 1 :]) + ") SELECT a, b, n, round(r, 5) + 0.0 AS r, abs(r) >= 0.9 AS strong FROM p")
def feature_correlations(spark, d):
    t = features.add_rolling(features.add_basic(telemetry(spark, d), "series"), "series")
    return review.correlations(t, _PAIRED, 0.9).select("a", "b", "n", *_round(("r",)), "strong")


_ALL = S.S81[1:]


@query(f"""WITH t AS (SELECT series, n, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _ALL)} FROM ({SQL81})), l AS MATERIALIZED (UNPIVOT t ON {', '.join(_ALL)} INTO NAME c VALUE v),
o AS (SELECT c, row_number() OVER () AS i FROM (SELECT unnest([{', '.join(f"'{c}'" for c in _ALL)}]) AS c)), k AS (SELECT series, n, c, v, i FROM l JOIN o USING (c)),
p AS (SELECT x.c AS a, y.c AS b, count(*) AS n, covar_pop(x.v, y.v) AS cov, stddev_pop(x.v) * stddev_pop(y.v) AS den FROM k x JOIN k y ON x.series = y.series AND x.n = y.n AND x.i < y.i GROUP BY x.c, y.c)
SELECT a, b, n, CASE WHEN den > 1e-12 THEN round(cov / den, 4) + 0.0 END AS r FROM p""")
def feature_correlation_matrix(spark, d):
    """All 3,160 pairs of the 80 columns in one scan."""
    return review.correlations(featured(spark, d), _ALL).where("n > 0").select("a", "b", "n", *_round(("r",), 4))


@query(f"""SELECT 'electrical_power_product' AS column_name, count(*) AS n, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std, round(min(x), 5) AS minimum, round(quantile_cont(x, 0.5), 5) AS median, round(max(x), 5) AS maximum FROM (SELECT Array_Voltage * Array_Current AS x FROM ({SQL14}))
UNION ALL SELECT 'power_consistency_residual', count(*), round(avg(x), 5), round(stddev_samp(x), 5), round(min(x), 5) + 0.0, round(quantile_cont(x, 0.5), 5), round(max(x), 5) FROM (SELECT Power_Generated - Array_Voltage * Array_Current AS x FROM ({SQL14}))""")
def residual_statistics(spark, d):
    t = features.add_basic(telemetry(spark, d), "series")
    return review.residual_statistics(t, ["electrical_power_product", "power_consistency_residual"]).select("column_name", "n", *_round(("mean", "std", "minimum", "median", "maximum")))


_MOMENTS = ("2022-04-27 01:00:00", "2022-04-27 01:30:00")


@query(f"""WITH t AS ({SQL14}), m AS (SELECT *, (epoch_us("Timestamp") - epoch_us(m)) / 6e7 AS off FROM t, (VALUES (TIMESTAMP '{_MOMENTS[0]}'), (TIMESTAMP '{_MOMENTS[1]}')) v(m) WHERE abs(epoch_us("Timestamp") - epoch_us(m)) <= 600000000)
SELECT count(*) AS n, round(corr(a.Power_Generated, b.Power_Generated), 5) AS r, round(avg(abs(a.Power_Generated - b.Power_Generated)), 5) AS mae FROM m a JOIN m b ON a.series = b.series AND a.off = b.off AND a.m = TIMESTAMP '{_MOMENTS[0]}' AND b.m = TIMESTAMP '{_MOMENTS[1]}'""")
def aligned_events(spark, d):
    moments = [pd.Timestamp(m).to_pydatetime() for m in _MOMENTS]
    near = review.near_events(telemetry(spark, d), moments, 10)
    return review.aligned(near, "Power_Generated", *moments, by=["series"]).select("n", *_round(("r", "mae")))


# --- splits and scores --------------------------------------------------------------------------

_PARTS = (("training", 0, 23), ("calibration", 24, 47), ("evaluation", 48, 10**9))


@query(f"SELECT {PART_SQL} AS part, count(*) AS n, min(n) AS first, max(n) AS last, count(CASE WHEN Solar_Radiation <= 5 THEN 1 END) AS low_light, count(CASE WHEN Solar_Radiation > 5 THEN 1 END) AS daylight, count(CASE WHEN Solar_Radiation <= 5 THEN 1 END) > 0 AND count(CASE WHEN Solar_Radiation > 5 THEN 1 END) > 0 AS ready FROM ({SQL14}) GROUP BY 1")
def split_coverage(spark, d):
    return review.split_coverage(features.add_basic(telemetry(spark, d), "series"), _PARTS)


@query(f"SELECT count(CASE WHEN n BETWEEN 24 AND 29 OR n >= 60 THEN 1 END) AS uncovered, count(CASE WHEN n BETWEEN 10 AND 23 THEN 1 END) AS repeated FROM ({SQL14})")
def split_gaps(spark, d):
    return review.uncovered(telemetry(spark, d), [("a", 0, 23), ("b", 10, 23), ("c", 30, 59)])


_SCALED = ["Power_Generated", "Solar_Radiation", "Wind_Speed"]
_PART14 = f"SELECT *, {PART_SQL} AS part FROM ({SQL14})"


@query(f"WITH t AS MATERIALIZED ({_PART14}) " + " UNION ALL ".join(f"""SELECT part AS partition, '{c}' AS column_name, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS std, round(avg(({c} - m) / s), 5) + 0.0 AS scaled_mean, round(stddev_pop(({c} - m) / s), 5) AS scaled_std, count(CASE WHEN {c} < lo THEN 1 END) AS below, count(CASE WHEN {c} > hi THEN 1 END) AS above, count(CASE WHEN abs(({c} - m) / s) > 2 THEN 1 END) AS beyond_2 FROM t, (SELECT avg({c}) AS m, stddev_pop({c}) AS s, min({c}) AS lo, max({c}) AS hi FROM t WHERE part = 'training') GROUP BY part""" for c in _SCALED))
def scaler_review(spark, d):
    return scores.scaler_review(parted(telemetry(spark, d)), _SCALED).select("partition", "column_name", *_round(("mean", "std", "scaled_mean", "scaled_std")), "below", "above", "beyond_2")


@query(f"WITH t AS MATERIALIZED ({_PART14}), g AS (" + " UNION ALL ".join(f"SELECT part, '{c}' AS column_name, avg({c}) AS m, stddev_pop({c}) AS s FROM t GROUP BY part" for c in _SCALED) + ") SELECT g.part AS partition, g.column_name, round((g.m - b.m) / b.s, 5) + 0.0 AS shift, abs((g.m - b.m) / b.s) >= 0.02 AS notable FROM g JOIN g b ON g.column_name = b.column_name AND b.part = 'training' WHERE g.part <> 'training'")
def mean_shifts(spark, d):
    return scores.mean_shifts(scores.scaler_review(parted(telemetry(spark, d)), _SCALED), notable=0.02).select("partition", "column_name", *_round(("shift",)), "notable")


@query(f"""WITH t AS MATERIALIZED ({_PART14}), b AS (SELECT avg(Power_Generated) AS m, stddev_pop(Power_Generated) AS s FROM t WHERE part = 'training')
SELECT part AS partition, count(*) AS n, round(avg(Power_Generated), 5) AS mean, round(stddev_pop(Power_Generated), 5) AS std, round(quantile_cont(Power_Generated, 0.5), 5) AS median, round(quantile_cont(Power_Generated, 0.9), 5) AS p90, round(quantile_cont(Power_Generated, 0.975), 5) AS p975, round(quantile_cont(Power_Generated, 0.99), 5) AS p99, round((avg(Power_Generated) - any_value(b.m)) / any_value(b.s), 5) + 0.0 AS shift FROM t, b GROUP BY part""")
def score_statistics(spark, d):
    return scores.score_statistics(parted(telemetry(spark, d)), score="Power_Generated").select("partition", "n", *_round(("mean", "std", "median", "p90", "p975", "p99", "shift")))


@query(f"SELECT part AS partition, CAST(CASE WHEN Solar_Radiation <= 5 THEN 1 ELSE 0 END AS BIGINT) AS context, count(*) AS n, round(avg(Power_Generated), 5) AS mean, round(quantile_cont(Power_Generated, 0.5), 5) AS median, round(max(Power_Generated), 5) AS maximum FROM ({_PART14}) GROUP BY 1, 2")
def context_statistics(spark, d):
    t = parted(features.add_basic(telemetry(spark, d), "series")).withColumn("context", F.col("low_light_context").cast("long"))
    return scores.context_statistics(t, score="Power_Generated").select("partition", "context", "n", *_round(("mean", "median", "maximum")))


@query(f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY Power_Generated DESC, "Timestamp", series) AS place FROM ({_PART14})),
w AS (SELECT part, max(c) AS most FROM (SELECT part, count(*) OVER (PARTITION BY part ORDER BY epoch_us("Timestamp") RANGE BETWEEN CURRENT ROW AND 600000000 FOLLOWING) AS c FROM k WHERE place <= 10) GROUP BY part)
SELECT k.part AS partition, count(*) AS rows, round((epoch_us(max("Timestamp")) - epoch_us(min("Timestamp"))) / 3.6e9, 6) AS span_hours, count(CASE WHEN Solar_Radiation <= 600 THEN 1 END) AS in_context, any_value(w.most) AS most_in_window FROM k JOIN w ON k.part = w.part WHERE place <= 10 GROUP BY 1""")
def top_summary(spark, d):
    t = parted(telemetry(spark, d)).withColumn("context", (F.col("Solar_Radiation") <= 600).cast("int"))
    # Power is the same in no two rows here, so the place in time breaks no tie.
    return scores.top_summary(t, 10, score="Power_Generated", minutes=10).select("partition", "rows", r6("span_hours").alias("span_hours"), "in_context", "most_in_window")


@query(f"""WITH t AS ({SQL14}), k AS (SELECT * FROM t WHERE event_id % 37 = 0)
SELECT k.series, k.n, round(avg(t.Power_Generated), 6) AS near FROM k LEFT JOIN t ON k.series = t.series AND abs(k.n - t.n) <= 5 AND k.n <> t.n GROUP BY 1, 2""")
def neighbour_means(spark, d):
    t = telemetry(spark, d)
    at = t.where("event_id % 37 = 0").select("series", "n", S.TIMESTAMP)
    return scores.neighbour_means(t, at, ["Power_Generated"], by=["series"]).select("series", "n", F.round("Power_Generated_near", 6).alias("near"))


@query(f"""WITH t AS ({SQL14}), r AS (SELECT Wind_Speed, rank() OVER (ORDER BY Power_Generated DESC) AS a, rank() OVER (ORDER BY Solar_Radiation DESC) AS b FROM t), m AS (SELECT abs(a - b) AS moved FROM r WHERE Wind_Speed > 2)
SELECT count(*) AS n, CAST(max(moved) AS BIGINT) AS largest, round(avg(moved), 5) AS mean, round(quantile_cont(moved, 0.5), 5) AS median FROM m""")
def rank_changes(spark, d):
    t = telemetry(spark, d)
    left, right = t.select("event_id", "Wind_Speed", F.col("Power_Generated").alias("anomaly_score")), t.select("event_id", F.col("Solar_Radiation").alias("anomaly_score"))
    return scores.rank_changes(left, right, F.col("Wind_Speed") > 2, "event_id").select("n", F.col("largest").cast("long").alias("largest"), *_round(("mean", "median")))


@query("SELECT count(CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 THEN 1 END) AS matched, count(CASE WHEN (o_orderkey % 4 = 0) <> (o_orderkey % 5 = 0) THEN 1 END) AS unmatched, round(max(CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderkey % 3 END) / 8.0, 6) AS largest, count(CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 = 2 THEN 1 END) AS beyond FROM orders")
def score_reproduction(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("anomaly_score"))
    fresh = o.where("o_orderkey % 5 <> 0").withColumn("anomaly_score", F.col("anomaly_score") + F.col("o_orderkey") % 3 / 8)
    return scores.reproduction(o.where("o_orderkey % 4 <> 0"), fresh, ["o_orderkey"], tolerance=0.2).select("matched", "unmatched", r6("largest").alias("largest"), "beyond")


@query("""WITH h AS (SELECT sha256(coalesce(strlen(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey, '-') || coalesce(strlen(o_orderstatus) || ':' || o_orderstatus, '-')) AS h FROM orders), s AS (SELECT count(*) AS rows, """ + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR) AS w{i}" for i in range(8)) + f""" FROM h) SELECT rows, sha256(concat_ws('|', {', '.join(f'w{i}' for i in range(8))})) AS digest FROM s""")
def table_digest(spark, d):
    return scores.table_digest(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"])


@query(f"WITH t AS ({SQL14}), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, x, y FROM (SELECT Power_Generated AS x, Air_Temp AS y FROM t)) SELECT count(*) AS n, round(corr(x, y), 5) + 0.0 AS pearson, round(corr(rx, ry), 5) + 0.0 AS spearman FROM k")
def safe_correlations(spark, d):
    return scores.safe_correlations(telemetry(spark, d), "Power_Generated", "Air_Temp").select("n", *_round(("pearson", "spearman")))


# --- synthetic events ------------------------------------------------------------------------------

def _direct():
    """Each series has one event in rows 10 to 14, which spreads through windows of up to 30 rows."""
    return F.col("n").between(10, 14)


def _context_sql():
    halved = ", ".join(f'"{c}"' if c != "Power_Generated" else "CASE WHEN n BETWEEN 10 AND 14 THEN Power_Generated / 2 ELSE Power_Generated END AS Power_Generated" for c in ("series", "n", "event_id", *S.S14))
    same = " AND ".join(f"coalesce((a.{c} IS NULL AND b.{c} IS NULL) OR abs(a.{c} - b.{c}) <= 1e-10 + 1e-12 * abs(b.{c}), false)" for c in S.S81[1:])
    return f"SELECT a.series, a.n, CASE WHEN a.n BETWEEN 10 AND 14 THEN 'direct' WHEN NOT ({same}) THEN 'propagated' ELSE 'none' END AS context FROM ({sql81(f'SELECT {halved} FROM ({SQL14})')}) a JOIN ({SQL81}) b ON a.series = b.series AND a.n = b.n"


@query(_context_sql())
def effect_context(spark, d):
    """Halved power in five rows; all 81 columns computed again; what differs without a label is propagated."""
    t = telemetry(spark, d)
    hit = t.withColumn("Power_Generated", F.when(_direct(), F.col("Power_Generated") / 2).otherwise(F.col("Power_Generated")))
    again = features.features(hit, "series").withColumn("synthetic_anomaly", _direct().cast("int"))
    return synthetic.effect_context(featured(spark, d), again, S.S81[1:], ["series", "n"]).select("series", "n", F.col("effect_context").alias("context"))


@query(f"""WITH t AS ({SQL14}), m AS (SELECT *, CASE WHEN Solar_Radiation > 740 THEN Power_Generated / 2 ELSE Power_Generated END AS p FROM t)
SELECT series, n, max(CASE WHEN Solar_Radiation > 740 THEN 1 ELSE 0 END) OVER w = 1 AS influenced, CASE WHEN n >= 14 THEN round(avg(CASE WHEN true THEN p END) OVER w, 5) END AS restored FROM m WINDOW w AS (PARTITION BY series ORDER BY n ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""")
def recompute_restore(spark, d):
    """Outside the influence of the changed cells the baseline's cells stand, and nothing differs from a full recomputation."""
    t = telemetry(spark, d)
    strong = F.col("Solar_Radiation") > 740
    again = featured_of(t.withColumn("Power_Generated", F.when(strong, F.col("Power_Generated") / 2).otherwise(F.col("Power_Generated"))))
    marked = synthetic.influenced(again, strong, 14, "n", ["series"])
    out = synthetic.restored(featured_of(t), marked, ["power_generated_roll_mean_30m"], key=["series", "n"])
    return out.select("series", "n", F.col("_influenced").alias("influenced"), F.round("power_generated_roll_mean_30m", 5).alias("restored"))


def featured_of(t):
    return features.add_rolling(features.add_basic(t, "series"), "series")


def _room_sql():
    parts = []
    for k in range(1, 5):
        near, guard = (f"OVER (PARTITION BY series ORDER BY n ROWS BETWEEN CURRENT ROW AND {x} FOLLOWING)" for x in (k - 1, k + 2))
        parts.append(f"CASE WHEN count(*) {near} = {k} AND min(CASE WHEN Solar_Radiation > 5 THEN 1 ELSE 0 END) {near} = 1 AND max(CASE WHEN Wind_Speed > 2.8 THEN 1 ELSE 0 END) {guard} = 0 THEN 1 ELSE 0 END")
    return " + ".join(parts)


@query(f"SELECT series, n, CAST({_room_sql()} AS INTEGER) AS room FROM ({SQL14})")
def eligible_starts(spark, d):
    """How many rows (at most 4) an event may last from each row: daylight in it, no wind in it and the three rows after."""
    t = telemetry(spark, d)
    found = synthetic.rooms(t, {"any": 4}, {"any": F.col("Solar_Radiation") > 5}, F.col("Wind_Speed") > 2.8, 3, pos="n", by=["series"])
    return found.select("series", "n", F.col("rooms.any").alias("room"))


@query(f"""SELECT count(*) AS kept FROM ({SQL14}) WHERE abs(epoch_us("Timestamp") - epoch_us(TIMESTAMP '{_MOMENTS[0]}')) > 1200000000 AND abs(epoch_us("Timestamp") - epoch_us(TIMESTAMP '{_MOMENTS[1]}')) > 1200000000""")
def exclusion_windows(spark, d):
    moments = [pd.Timestamp(m).to_pydatetime() for m in _MOMENTS]
    return telemetry(spark, d).where(~synthetic.excluded(F.col(S.TIMESTAMP).cast("timestamp"), [F.lit(m) for m in moments], 20)).agg(F.count("*").alias("kept"))


_CONTEXT = "CASE WHEN n BETWEEN 10 AND 14 THEN 'direct' WHEN n BETWEEN 15 AND 43 THEN 'propagated' ELSE 'none' END"


def _evaluated(spark, d):
    context = F.when(_direct(), "direct").when(F.col("n").between(15, 43), "propagated").otherwise("none")
    score = F.col("Power_Generated")
    t = telemetry(spark, d).select("series", "n", S.TIMESTAMP, score.alias("anomaly_score"), (score / 2).alias("baseline"), context.alias("effect_context"), F.when(score > 40, "ALERT").otherwise("NORMAL").alias("status"))
    own = F.concat(F.lit("e-"), F.col("series").cast("string"))
    return t.withColumns({"synthetic_anomaly_id": F.when(_direct(), own), "event": F.when(F.col("n").between(10, 43), own)})


_EVALUATED = f"""SELECT series, n, "Timestamp", Power_Generated AS score, {_CONTEXT} AS context, Power_Generated > 40 AS alert FROM ({SQL14})"""


@query(f"""SELECT series, count(CASE WHEN context = 'direct' THEN 1 END) AS direct_rows, count(CASE WHEN context = 'direct' AND alert THEN 1 END) AS direct_flagged, count(CASE WHEN context <> 'direct' THEN 1 END) AS propagated_rows, count(CASE WHEN context <> 'direct' AND alert THEN 1 END) AS propagated_flagged, round(max(CASE WHEN context = 'direct' THEN score END), 5) AS max_direct_score,
 round(avg(CASE WHEN context = 'direct' THEN score / 2 END), 5) AS mean_delta, count(CASE WHEN context = 'direct' AND alert THEN 1 END) > 0 AS detected, CASE WHEN min(CASE WHEN alert THEN n END) <= 14 THEN 'during_direct' WHEN min(CASE WHEN alert THEN n END) IS NOT NULL THEN 'during_tail' ELSE 'none' END AS response, round((min(CASE WHEN alert THEN n END) - min(n)) * 2.0, 5) AS delay_minutes
 FROM ({_EVALUATED}) WHERE n BETWEEN 10 AND 43 GROUP BY series""")
def event_eval(spark, d):
    """One event a series, all series."""
    found = events.evaluate_events(_evaluated(spark, d), baseline="baseline", by=("series",))
    return found.select("series", "direct_rows", "direct_flagged", "propagated_rows", "propagated_flagged", F.round("max_direct_score", 5).alias("max_direct_score"), F.round("mean_delta", 5).alias("mean_delta"), "detected", "response", F.round("delay_minutes", 5).alias("delay_minutes"))


@query(f"""WITH a AS (SELECT *, n - row_number() OVER (PARTITION BY series ORDER BY n) AS g FROM ({_EVALUATED}) WHERE alert)
SELECT series, min(n) AS first_n, count(*) AS row_count, array_to_string(list_sort(list(DISTINCT context)), ',') AS contexts, CASE WHEN bool_or(context = 'direct') THEN 'direct_overlap' WHEN bool_and(context = 'propagated') THEN 'propagated_only' WHEN bool_and(context = 'none') THEN 'unaffected_only' ELSE 'mixed' END AS classification FROM a GROUP BY series, g""")
def alert_event_classes(spark, d):
    t = _evaluated(spark, d)
    runs = events.group_alert_events(t, by=("series",))
    found = events.classify_alert_events(t, runs, by=("series",))
    first = ((F.unix_micros(F.col("start_timestamp").cast("timestamp")) - F.lit(int(pd.Timestamp("2022-04-27").value // 1000))) / 120_000_000).cast("long")
    return found.select("series", first.alias("first_n"), "row_count", F.array_join("effect_contexts", ",").alias("contexts"), "classification")


@query(f"""WITH t AS ({SQL14}), l AS (SELECT series, max(CASE WHEN n BETWEEN 10 AND 14 THEN Power_Generated END) AS event_maximum, max(CASE WHEN n NOT BETWEEN 10 AND 14 THEN Power_Generated END) AS history_maximum, avg(CASE WHEN n BETWEEN 5 AND 9 OR n BETWEEN 15 AND 19 THEN Power_Generated END) AS near FROM t GROUP BY series)
SELECT series, round(event_maximum, 5) AS event_maximum, round(history_maximum, 5) AS history_maximum, round(near, 5) AS neighbour_mean, event_maximum > history_maximum AS beyond_history FROM l WHERE event_maximum IS NOT NULL""")
def spike_review(spark, d):
    return review.spike_review(telemetry(spark, d), "Power_Generated", _direct()).select("series", *_round(("event_maximum", "history_maximum", "neighbour_mean")), "beyond_history")


@query(f"""WITH t AS ({SQL14}), w AS (SELECT min(Power_Generated) AS lo, max(Power_Generated) AS hi FROM t) SELECT 'e-' || series AS event, 'Power_Generated' AS column_name, round(min(Power_Generated), 5) AS minimum, round(max(Power_Generated), 5) AS maximum, round(avg(Power_Generated), 5) AS mean, min(Power_Generated) < any_value(lo) OR max(Power_Generated) > any_value(hi) AS outside FROM t, w WHERE n BETWEEN 10 AND 14 GROUP BY series""")
def event_summary(spark, d):
    t = telemetry(spark, d).withColumn("event", F.when(_direct(), F.concat(F.lit("e-"), F.col("series").cast("string"))))
    return review.event_summary(t, ["Power_Generated"], "event").select("event", "column_name", *_round(("minimum", "maximum", "mean")), "outside")


@query(f"""SELECT 'e-' || series AS event, count(*) AS rows, 'Array_Voltage,Power_Generated' AS columns FROM ({SQL14}) WHERE n BETWEEN 10 AND 14 GROUP BY series""")
def changed_columns(spark, d):
    t = telemetry(spark, d)
    hit = t.withColumns({c: F.when(_direct(), F.col(c) / 2).otherwise(F.col(c)) for c in ("Power_Generated", "Array_Voltage")}).withColumn("event", F.when(_direct(), F.concat(F.lit("e-"), F.col("series").cast("string"))))
    return review.changed_columns(t, hit, S.MEASUREMENTS, "event").select("event", "rows", F.array_join("columns", ",").alias("columns"))


_LIMITS = {"low": 40.0, "high": 60.0}


@query(f"""WITH t AS (SELECT * FROM ({SQL14})), a AS (SELECT rule, threshold, series, n, Solar_Radiation FROM t, (VALUES ('low', 40.0), ('high', 60.0)) v(rule, threshold) WHERE Power_Generated > threshold),
e AS (SELECT rule, series, count(*) AS k FROM (SELECT *, n - row_number() OVER (PARTITION BY rule, series ORDER BY n) AS g FROM a) GROUP BY rule, series, g)
SELECT a.rule, a.flagged, round(a.flagged * 100.0 / (SELECT count(*) FROM t), 6) AS flagged_percentage, e.events, round(e.med, 6) AS median_minutes, e.longest AS maximum_minutes, e.alone AS isolated_events, a.low_light AS low_light_flagged
FROM (SELECT rule, count(*) AS flagged, count(CASE WHEN Solar_Radiation <= 600 THEN 1 END) AS low_light FROM a GROUP BY rule) a JOIN (SELECT rule, count(*) AS events, quantile_cont(k * 2, 0.5) AS med, CAST(max(k * 2) AS BIGINT) AS longest, count(CASE WHEN k = 1 THEN 1 END) AS alone FROM e GROUP BY rule) e ON a.rule = e.rule""")
def flag_summaries(spark, d):
    t = telemetry(spark, d).withColumn("anomaly_score", F.col("Power_Generated"))
    rules = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(_LIMITS.items())], "declared int, rule string, threshold double")
    found = flag_summary(t, rules, low_light=F.col("Solar_Radiation") <= 600, by=("series",))
    return found.select("rule", "flagged", r6("flagged_percentage").alias("flagged_percentage"), "events", r6("median_minutes").alias("median_minutes"), "maximum_minutes", "isolated_events", "low_light_flagged")


# --- a frozen detector --------------------------------------------------------------------------------

#: A forest of two small trees over three inputs, for scores that SQL can give: node, feature, threshold, left, right, path.
FIXED = [(0, 0, 0, 0.0, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 1.5), (0, 2, 1, 0.05, 3, 4, 0.0), (0, 3, -1, 0.0, -1, -1, 2.0), (0, 4, -1, 0.0, -1, -1, 3.5), (1, 0, 2, -0.1, 1, 2, 0.0), (1, 1, -1, 0.0, -1, -1, 1.0), (1, 2, -1, 0.0, -1, -1, 4.0)]
_PSI = 16


def _fixed_forest():
    forest = pd.DataFrame(FIXED, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])
    forest.attrs["psi"] = _PSI
    return forest


def _fixed_sql(x, y, z):
    from ..operators.iforest import average_path

    paths = f"CASE WHEN {x} <= 0 THEN 1.5 WHEN {y} <= 0.05 THEN 2.0 ELSE 3.5 END + CASE WHEN {z} <= -0.1 THEN 1.0 ELSE 4.0 END"
    return f"pow(2, -(CAST({paths} AS DOUBLE) / 2) / {average_path(_PSI)!r})"


@query(f"SELECT vec_id, round({_fixed_sql('CAST(embedding[1] AS DOUBLE)', 'CAST(embedding[2] AS DOUBLE)', 'CAST(embedding[3] AS DOUBLE)')}, 6) AS anomaly_score FROM embeddings")
def iforest_score_fixed(spark, d):
    from ..operators.iforest import score

    rows = table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)))
    return score(rows, _fixed_forest(), ["x0", "x1", "x2"]).select("vec_id", r6("anomaly_score").alias("anomaly_score"))


_FROZEN = {"Power_Generated": (80.0, 40.0), "Solar_Radiation": (300.0, 200.0), "Wind_Speed": (1.5, 1.0)}


def _detector():
    return serving.Detector(tuple(_FROZEN), _FROZEN, _fixed_forest(), _PSI, 0.62)


_FROZEN_SQL = f"""SELECT *, {_fixed_sql('(Power_Generated - 80) / 40', '(Solar_Radiation - 300) / 200', '(Wind_Speed - 1.5)')} AS s FROM ({SQL14})"""


@query(f"SELECT series, n, round(s, 6) AS anomaly_score, CAST(0.62 AS DOUBLE) AS threshold, round(s - 0.62, 6) + 0.0 AS threshold_margin, CASE WHEN s > 0.62 THEN 'ALERT' ELSE 'NORMAL' END AS status FROM ({_FROZEN_SQL})")
def frozen_score(spark, d):
    return serving.score_frame(telemetry(spark, d), _detector(), ["series", "n"]).select("series", "n", *_round(("anomaly_score",), 6), "threshold", *_round(("threshold_margin",), 6), "status")


@query(f"SELECT series, epoch_us(\"Timestamp\") AS us, round(Power_Generated, 6) AS Power_Generated, round(Solar_Radiation, 6) + 0.0 AS Solar_Radiation, round(s, 6) AS anomaly_score, CASE WHEN s > 0.62 THEN 'ALERT' ELSE 'NORMAL' END AS status FROM ({_FROZEN_SQL})")
def feed_export(spark, d):
    found = serving.feed(telemetry(spark, d), _detector(), by=["series"])
    return found.select("series", F.unix_micros(F.col(S.TIMESTAMP).cast("timestamp")).alias("us"), *_round(("Power_Generated", "Solar_Radiation", "anomaly_score"), 6), "status")


@query(f"""WITH t AS MATERIALIZED ({_FROZEN_SQL}) SELECT count(*) AS rows, count(CASE WHEN s > 0.62 THEN 1 END) AS alerts, round(max(s), 6) AS highest, round(count(CASE WHEN s > 0.62 THEN 1 END) * 100.0 / count(*), 6) AS alert_percentage, (SELECT count(*) FROM (SELECT DISTINCT series, n - k FROM (SELECT series, n, row_number() OVER (PARTITION BY series ORDER BY n) AS k FROM t WHERE s > 0.62))) AS events FROM t""")
def dashboard_summary(spark, d):
    scored = serving.score_frame(telemetry(spark, d), _detector(), ["series", S.TIMESTAMP])
    return serving.dashboard_summary(scored, by=("series",)).select("rows", "alerts", r6("highest").alias("highest"), r6("alert_percentage").alias("alert_percentage"), "events")


@query("SELECT event_id, CAST(greatest(0, least(event_id % 100 + event_id % 9 - 4, 80 - 1)) AS BIGINT) AS moved FROM events")
def replay_moves(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", serving.move_index(i % 100, i % 9 - 4, F.lit(80)).cast("long").alias("moved"))


@query("SELECT doc_id, regexp_replace(url_like, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM (SELECT doc_id, source || ' (' || doc_id || ')/' || lang AS url_like FROM documents)")
def safe_names(spark, d):
    name = F.concat(F.col("source"), F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")/"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", serving.safe_name(name).alias("safe"))

"""Registry of the reference-parity queries over the driver's tables: name -> (query, SQL).

Every float is rounded on both sides, every order is total, every division is guarded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import category, corr, cyclic, row_stats, safe_ratio, safe_relative_change, status
from ..functions.ordering import counts_ahead, percentiles, positions, time_buckets, with_group, with_ranks
from ..functions.windows import changed, full, islands, ordered
from ..operators.calibration import candidate_thresholds, rank_stability
from ..operators.events import confusion, group_alert_events
from ..operators.gates import paired
from ..operators.profile import timestamp_profile
from ..operators.scores import delta_summary

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        FOUND[name or f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict:
    from . import compare_queries, model_queries, placement_queries, stage_queries, stream_queries, transition_queries, vision_queries  # noqa: F401  they add theirs

    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in FOUND.items() if s}


def r6(c):
    return F.round(c, 6)


def by_user():
    """Columns and windows need a session, so they are made when a query runs."""
    return ordered(["user_id"], ["ts", "event_id"])


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def events(spark, d):
    return table(spark, d, "events")


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return df.select(F.expr(f"stack({len(columns)}, {pairs}) as (column_name, value)"))


UNPIVOT = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM lineitem" for c in NUMERIC)


# --- profiles -----------------------------------------------------------------------------


@query("""
WITH g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS us FROM (SELECT DISTINCT ts FROM events)),
m AS (SELECT quantile_cont(us / 1e6, 0.5) AS med FROM g)
SELECT (SELECT count(*) FROM events) AS n, (SELECT count(*) - count(DISTINCT ts) FROM events) AS duplicates,
 round(med, 6) AS median_gap, round(min(us) / 1e6, 6) AS min_gap, round(max(us) / 1e6, 6) AS max_gap,
 CAST(count(CASE WHEN abs(us / 1e6 - med) > 1 THEN 1 END) AS BIGINT) AS irregular,
 CAST(sum(CASE WHEN us / 1e6 > med + 1 THEN greatest(round_even(us / 1e6 / med, 0) - 1, 0) ELSE 0 END) AS BIGINT) AS missing
FROM g, m GROUP BY med""")
def ts_profile(spark, d):
    return timestamp_profile(events(spark, d), "ts").select("n", "duplicates", r6("median_gap").alias("median_gap"), r6("min_gap").alias("min_gap"), r6("max_gap").alias("max_gap"), "irregular", "missing")


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS n_distinct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS duplicates FROM documents")
def duplicate_rows(spark, d):
    docs = table(spark, d, "documents").groupBy("text", "lang", "source").agg(F.count("*").alias("c"))
    return docs.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_distinct"), (F.sum("c") - F.count("*")).alias("duplicates"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n = 1")
def dedupe_keep_first(spark, d):
    w = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


@query("SELECT 'lang' AS column_name, count(*) - count(lang) AS missing, count(DISTINCT lang) + max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) AS n_unique FROM documents UNION ALL SELECT 'source', count(*) - count(source), count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) FROM documents")
def missing_and_distinct(spark, d):
    rows = table(spark, d, "documents").select(F.expr("stack(2, 'lang', lang, 'source', source) as (column_name, value)"))
    null = F.col("value").isNull()
    return rows.groupBy("column_name").agg(F.count_if(null).alias("missing"), (F.count_distinct("value") + F.max(null.cast("long"))).alias("n_unique"))


RULES_SQL = {"quantity_over_45": ("l_quantity > 45", "l_quantity"), "discount_over_5": ("l_discount > 0.05", "l_discount"), "tax_zero": ("l_tax <= 0", "l_tax"), "price_over_50k": ("l_extendedprice > 50000", "l_extendedprice")}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n, round(min({c}), 6) AS lo, round(max({c}), 6) AS hi FROM lineitem WHERE {s}" for k, (s, c) in RULES_SQL.items()))
def range_flags(spark, d):
    """Rows outside physical ranges are counted, never dropped; one scan for all rules."""
    rules = {"quantity_over_45": F.col("l_quantity") > 45, "discount_over_5": F.col("l_discount") > 0.05, "tax_zero": F.col("l_tax") <= 0, "price_over_50k": F.col("l_extendedprice") > 50000}
    stats = [F.struct(F.lit(k).alias("rule"), F.count_if(rules[k]).alias("n"), r6(F.min(F.when(rules[k], F.col(c)))).alias("lo"), r6(F.max(F.when(rules[k], F.col(c)))).alias("hi")) for k, (_, c) in RULES_SQL.items()]
    return table(spark, d, "lineitem").agg(F.array(*stats).alias("a")).select(F.inline("a"))


@query(f"SELECT column_name, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS lo, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS hi FROM ({UNPIVOT}) GROUP BY column_name")
def numeric_summary(spark, d):
    """Moments in one pass over the wide rows; medians from the distribution of each column."""
    u = unpivoted(table(spark, d, "lineitem"), NUMERIC)
    cells = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi")) for c in NUMERIC]
    moments = table(spark, d, "lineitem").agg(F.array(*cells).alias("x")).select(F.inline("x"))
    medians = percentiles(u, "value", {"median": 0.5}, ["column_name"])
    return moments.join(medians, "column_name").select("column_name", "n", *(r6(c).alias(c) for c in ("mean", "std", "lo", "median", "hi")))


@query(f"SELECT column_name, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.975), 6) AS p975 FROM ({UNPIVOT}) GROUP BY column_name")
def schema_summary(spark, d):
    p = percentiles(unpivoted(table(spark, d, "lineitem"), NUMERIC), "value", {"p25": 0.25, "p75": 0.75, "p975": 0.975}, ["column_name"])
    return p.select("column_name", *(r6(c).alias(c) for c in ("p25", "p75", "p975")))


@query(f"""WITH u AS ({UNPIVOT}), c AS (SELECT column_name, value, count(*) AS k FROM u GROUP BY 1, 2),
s AS (SELECT column_name, sum(k) AS n, max(k) AS top, count(*) AS distinct_values, sum(k * value) / sum(k) AS mean, sqrt(greatest(sum(k * value * value) / sum(k) - (sum(k * value) / sum(k)) * (sum(k * value) / sum(k)), 0)) AS sd FROM c GROUP BY 1)
SELECT column_name, CAST(distinct_values AS BIGINT) AS distinct_values, round(top / n, 6) AS mode_share, CASE WHEN distinct_values = 1 THEN 'constant' WHEN top / n >= 0.95 OR (abs(mean) > 1e-12 AND sd / abs(mean) <= 0.01) THEN 'near_constant' ELSE 'variable' END AS status FROM s""")
def variability_status(spark, d):
    c = unpivoted(table(spark, d, "lineitem"), NUMERIC).groupBy("column_name", "value").agg(F.count("*").alias("k"))
    s = c.groupBy("column_name").agg(F.sum("k").alias("n"), F.max("k").alias("top"), F.count("*").alias("distinct_values"), F.sum(F.col("k") * F.col("value")).alias("t"), F.sum(F.col("k") * F.col("value") ** 2).alias("q"))
    mean = F.col("t") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    near = (F.col("top") / F.col("n") >= 0.95) | ((F.abs(mean) > 1e-12) & (F.try_divide(sd, F.abs(mean)) <= 0.01))
    return s.select("column_name", "distinct_values", r6(F.col("top") / F.col("n")).alias("mode_share"), category(F.col("k"), [(F.col("distinct_values") == 1, "constant"), (near, "near_constant")], "variable").alias("status"))


@query("WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin, count(*) AS n FROM events, b GROUP BY 1")
def histogram_30(spark, d):
    e = events(spark, d)
    b = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 30), F.lit(29).cast("long"))
    return e.select("value").crossJoin(F.broadcast(b)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT CAST(h AS BIGINT) AS hour, count(event_id) AS n, count(event_id) = 0 AS absent, count(event_id) < 30 AS under_represented FROM range(24) t(h) LEFT JOIN events ON hour(ts) = h GROUP BY h")
def hourly_coverage_zero_fill(spark, d):
    hours = spark.range(24).select(F.col("id").alias("hour"))
    n = events(spark, d).groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    j = hours.join(n, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))
    return j.select("hour", "n", (F.col("n") == 0).alias("absent"), (F.col("n") < 30).alias("under_represented"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def daily_counts(spark, d):
    return events(spark, d).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))


@query("SELECT CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS minute_of_day, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def daily_profile(spark, d):
    return events(spark, d).groupBy((F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("minute_of_day")).agg(r6(F.avg("value")).alias("mean_value"))


# --- scalar and row-wise ------------------------------------------------------------------


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day, round((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 6e7, 4) AS elapsed_minutes FROM events")
def time_features(spark, d):
    e = events(spark, d).select("event_id", "ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = e.agg(F.min(us).alias("start"))
    return e.crossJoin(F.broadcast(start)).select("event_id", F.hour("ts").alias("hour"), F.minute("ts").alias("minute"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute_of_day"), F.round((us - F.col("start")) / 6e7, 4).alias("elapsed_minutes"))


@query("SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos FROM events")
def cyclic_features(spark, d):
    s, c = cyclic(F.hour("ts"), 24)
    return events(spark, d).select("event_id", (r6(s) + 0.0).alias("hour_sin"), (r6(c) + 0.0).alias("hour_cos"))


@query("SELECT vec_id, round(list_avg(x), 5) AS mean, round(list_stddev_pop(x), 5) AS std, round(list_min(x), 5) AS lo, round(list_max(x), 5) AS hi, round(list_max(x) - list_min(x), 5) AS spread FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)")
def rowwise_stats(spark, d):
    s = row_stats(F.col("embedding").cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", *(F.round(s[k], 5).alias(n) for k, n in (("mean", "mean"), ("std", "std"), ("min", "lo"), ("max", "hi"), ("range", "spread"))))


@query("SELECT vec_id, CAST(list_position(a, list_max(a)) AS BIGINT) AS argmax, round(list_max(a), 5) AS top, CAST(len(list_filter(a, lambda x: x > 0.2)) AS BIGINT) AS above FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS a FROM embeddings)")
def argmax_feature(spark, d):
    a = F.transform(F.col("embedding").cast("array<double>"), F.abs)
    return table(spark, d, "embeddings").select("vec_id", F.array_position(a, F.array_max(a)).alias("argmax"), F.round(F.array_max(a), 5).alias("top"), F.size(F.filter(a, lambda x: x > 0.2)).cast("long").alias("above"))


LAG = "lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, CASE WHEN abs(p) >= 10 THEN round((value - p) / p, 6) END AS change FROM (SELECT event_id, value, {LAG} AS p FROM events)")
def relative_change_safe(spark, d):
    return events(spark, d).select("event_id", r6(safe_relative_change(F.col("value"), F.lag("value").over(by_user()), 10)).alias("change"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount) >= 0.02 THEN round(l_tax / l_discount, 6) END AS ratio FROM lineitem")
def ratio_safe(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(safe_ratio(F.col("l_tax"), F.col("l_discount"), 0.02)).alias("ratio"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '0 .5 .5 .2 .2' WHEN 1 THEN 'x .5 .5 .2 .2' WHEN 2 THEN '9 .5 .5 .2 .2' WHEN 3 THEN '0 1.1 .5 .2 .2' WHEN 4 THEN '1 .5 .5 0 .2' ELSE '1 .5 .5' END AS line FROM part),
t AS (SELECT p_partkey, string_split(line, ' ') AS f FROM p)
SELECT p_partkey, CASE WHEN len(f) <> 5 THEN 'fields' WHEN TRY_CAST(f[1] AS INTEGER) IS NULL THEN 'class_text' WHEN CAST(f[1] AS INTEGER) NOT BETWEEN 0 AND 5 THEN 'class_range' WHEN CAST(f[2] AS DOUBLE) NOT BETWEEN 0 AND 1 OR CAST(f[3] AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'centre' WHEN CAST(f[4] AS DOUBLE) <= 0 OR CAST(f[4] AS DOUBLE) > 1 OR CAST(f[5] AS DOUBLE) <= 0 OR CAST(f[5] AS DOUBLE) > 1 THEN 'size' ELSE 'ok' END AS error FROM t""")
def label_line_parse(spark, d):
    from ..operators.vision import parse_label_lines

    k = F.col("p_partkey") % 6
    line = category(k, [(k == 0, "0 .5 .5 .2 .2"), (k == 1, "x .5 .5 .2 .2"), (k == 2, "9 .5 .5 .2 .2"), (k == 3, "0 1.1 .5 .2 .2"), (k == 4, "1 .5 .5 0 .2")], "1 .5 .5")
    return parse_label_lines(table(spark, d, "part").select("p_partkey", line.alias("line")), "line", 6).select("p_partkey", "error")


# --- windows --------------------------------------------------------------------------------

for _n in (5, 15, 30):

    def _rolling(spark, d, n=_n):
        f = lambda agg: full(agg("value"), F.col("value"), n, by_user())
        return events(spark, d).select("event_id", r6(f(F.avg)).alias("mean"), F.round(f(F.stddev_pop), 5).alias("std"), r6(f(F.min)).alias("lo"), r6(f(F.max)).alias("hi"))

    _w = f"(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {_n - 1} PRECEDING AND CURRENT ROW)"
    query(f"SELECT event_id, CASE WHEN n = {_n} THEN round(mean, 6) END AS mean, CASE WHEN n = {_n} THEN round(std, 5) END AS std, CASE WHEN n = {_n} THEN round(lo, 6) END AS lo, CASE WHEN n = {_n} THEN round(hi, 6) END AS hi FROM (SELECT event_id, count(value) OVER {_w} AS n, avg(value) OVER {_w} AS mean, stddev_pop(value) OVER {_w} AS std, min(value) OVER {_w} AS lo, max(value) OVER {_w} AS hi FROM events)", f"rolling_full_{_n}")(_rolling)


@query(f"SELECT event_id, round(value - {LAG}, 6) AS diff, round((value - {LAG}) / 2.0, 6) AS rate FROM events")
def diff_rate(spark, d):
    diff = F.col("value") - F.lag("value").over(by_user())
    return events(spark, d).select("event_id", r6(diff).alias("diff"), r6(diff / 2).alias("rate"))


@query("SELECT event_id, CASE WHEN n = 15 THEN round(value - m, 6) END AS deviation FROM (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))")
def deviation_from_rolling(spark, d):
    return events(spark, d).select("event_id", r6(F.col("value") - full(F.avg("value"), F.col("value"), 15, by_user())).alias("deviation"))


@query("""WITH s AS (SELECT *, value > 50 AS state, lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
r AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> state THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
SELECT user_id, CAST(run AS BIGINT) AS run, state, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM r GROUP BY user_id, run, state""")
def run_length_periods(spark, d):
    e = events(spark, d).withColumn("state", F.col("value") > 50)
    return islands(e, changed(F.col("state"), by_user()), by_user(), "run").groupBy("user_id", "run", "state").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("WITH f AS (SELECT event_id, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE value > 100) SELECT min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM f GROUP BY g HAVING count(*) > 1")
def consecutive_positions(spark, d):
    """Islands of consecutive ids: id minus place is the same through a run."""
    f = positions(events(spark, d).where("value > 100").select("event_id"), "event_id")
    return f.groupBy(F.col("event_id") - F.col("_pos")).agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "last_id", "n")


def _scored(spark, d):
    m, s = full(F.avg("value"), F.col("value"), 5, by_user()), full(F.stddev_pop("value"), F.col("value"), 5, by_user())
    z = safe_ratio(F.col("value") - m, s, 1e-9)
    return events(spark, d).withColumn("anomaly_score", z).withColumn("status", status(F.col("anomaly_score"), 0.5))


SCORED = """SELECT *, CASE WHEN z > 0.5 THEN 'ALERT' ELSE 'NORMAL' END AS status FROM (SELECT *, CASE WHEN n = 5 AND s >= 1e-9 THEN (value - m) / s END AS z FROM (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))"""


def _islands_sql(seconds: int, test: str) -> str:
    return f"""WITH a AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM ({SCORED}) WHERE status = 'ALERT'),
r AS (SELECT *, sum(CASE WHEN gap {test} {seconds * 1000000} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM a)
SELECT 'alert-' || lpad(CAST(run AS VARCHAR), 3, '0') AS event_id, user_id, epoch_us(min(ts)) AS start_us, count(*) AS row_count, CAST(floor(((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 + {seconds}) / 60) AS BIGINT) AS duration_minutes, round(max(z), 6) AS max_score, round(avg(z), 6) AS mean_score FROM r GROUP BY user_id, run"""


def _alerts(spark, d, seconds, exact):
    g = group_alert_events(_scored(spark, d), "ts", by=("user_id",), gap_seconds=seconds, exact=exact)
    return g.select("event_id", "user_id", F.unix_micros(F.col("start_timestamp").cast("timestamp")).alias("start_us"), "row_count", "duration_minutes", r6("maximum_anomaly_score").alias("max_score"), r6("mean_anomaly_score").alias("mean_score"))


query(_islands_sql(120, "="), "alert_islands_exact")(lambda spark, d: _alerts(spark, d, 120, True))
query(_islands_sql(36000, "<="), "alert_islands_gap")(lambda spark, d: _alerts(spark, d, 36000, False))


@query("SELECT event_id, lag(event_id) OVER w AS previous_id, lead(event_id) OVER w AS next_id, round(lag(value) OVER w, 6) AS previous_value, round(lead(value) OVER w, 6) AS next_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def neighbour_rows(spark, d):
    row = F.struct("event_id", "value")
    return events(spark, d).select("event_id", F.lag(row).over(by_user()).alias("p"), F.lead(row).over(by_user()).alias("n")).select("event_id", F.col("p.event_id").alias("previous_id"), F.col("n.event_id").alias("next_id"), r6("p.value").alias("previous_value"), r6("n.value").alias("next_value"))


@query("SELECT event_type, max(n) AS max_count FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 60 MINUTE FOLLOWING) AS n FROM events) GROUP BY event_type")
def max_in_60min(spark, d):
    hour = 3_600_000_000
    e = events(spark, d).select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return counts_ahead(e, "us", hour, ["event_type"]).groupBy("event_type").agg(F.max("n").alias("max_count"))


@query("SELECT event_id, n - 1 AS others, CASE WHEN n > 1 THEN round((s - value) / (n - 1), 5) END AS mean_others FROM (SELECT event_id, value, count(*) OVER w AS n, sum(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND INTERVAL 10 MINUTE FOLLOWING))")
def nearby_10min_stats(spark, d):
    near = 600_000_000
    e = events(spark, d).select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("event_type", "_bucket").orderBy("us").rangeBetween(-near, near)
    rows = time_buckets(e, "us", near, 1, 1).withColumns({"n": F.count("*").over(w), "s": F.sum("value").over(w)}).where("_own")
    return rows.select("event_id", (F.col("n") - 1).alias("others"), F.when(F.col("n") > 1, F.round((F.col("s") - F.col("value")) / (F.col("n") - 1), 5)).alias("mean_others"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS rank_desc, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) * 100, 6) AS percentile FROM orders")
def rank_min_desc(spark, d):
    ranked = with_ranks(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_totalprice", ["o_orderstatus"])
    return ranked.select("o_orderkey", F.col("rank_desc").cast("long").alias("rank_desc"), r6(F.col("share") * 100).alias("percentile"))


@query(f"WITH c AS (SELECT event_id, value - {LAG} AS diff FROM events) SELECT event_id, round(diff, 6) AS diff FROM c WHERE diff IS NOT NULL ORDER BY abs(diff) DESC, event_id LIMIT 10")
def topk_abs_change(spark, d):
    diff = F.col("value") - F.lag("value").over(by_user())
    return events(spark, d).select("event_id", diff.alias("diff")).where("diff is not null").orderBy(F.desc(F.abs("diff")), "event_id").limit(10).select("event_id", r6("diff").alias("diff"))


@query("SELECT event_type, event_id, round(value, 6) AS value, CAST(n AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 10")
def topk_per_group(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return events(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 10").select("event_type", "event_id", r6("value").alias("value"), F.col("place").cast("long").alias("place"))


@query("SELECT event_id, max(CASE WHEN value > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS affected FROM events")
def dependency_spread(spark, d):
    return events(spark, d).select("event_id", F.max((F.col("value") > 400).cast("int")).over(by_user().rowsBetween(-14, 0)).alias("affected"))


# --- correlation, distribution, thresholds ---------------------------------------------------

PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i:]]


def _corr_sql(a, b):
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round((avg({a} * {b}) - avg({a}) * avg({b})) / (stddev_pop({a}) * stddev_pop({b})), 5) AS r FROM lineitem"


@query(" UNION ALL ".join(_corr_sql(a, b) for a, b in PAIRS))
def corr_matrix(spark, d):
    """All pairs in one pass of moments; no self-join."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), F.round(corr(F.col(a), F.col(b)), 5).alias("r")) for a, b in PAIRS]
    return table(spark, d, "lineitem").agg(F.array(*cells).alias("x")).select(F.inline("x"))


@query(f"SELECT a, b, n, r FROM ({' UNION ALL '.join(_corr_sql(a, b) for a, b in PAIRS if a != b)}) WHERE abs(r) >= 0.001")
def strong_pairs(spark, d):
    return corr_matrix(spark, d).where("a <> b and abs(r) >= 0.001")


@query("WITH j AS (SELECT o_totalprice AS x, c_acctbal AS y FROM orders JOIN customer ON o_custkey = c_custkey), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j) SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k")
def spearman(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_totalprice").alias("x"), F.col("c_acctbal").alias("y"))
    k = with_ranks(with_ranks(j, "x", names=("rx", "_dx", "_sx")), "y", names=("ry", "_dy", "_sy"))
    return k.agg(F.count("*").alias("n"), r6(corr(F.col("rx"), F.col("ry"))).alias("rho"))


BOUNDS = [("training", 0, 0.5), ("calibration", 0.5, 0.75), ("evaluation", 0.75, 1.01)]
PARTS = "SELECT *, CASE WHEN q < 0.5 THEN 'training' WHEN q < 0.75 THEN 'calibration' ELSE 'evaluation' END AS part FROM (SELECT *, (epoch_us(ts) - lo) / CAST(hi - lo AS DOUBLE) AS q FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events))"


def _parts(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events(spark, d)
    b = e.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    q = (us - F.col("lo")) / (F.col("hi") - F.col("lo")).cast("double")
    return e.crossJoin(F.broadcast(b)).withColumn("part", category(q, [(q < 0.5, "training"), (q < 0.75, "calibration")], "evaluation"))


@query(f"SELECT part, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM ({PARTS}) GROUP BY part")
def chronological_split(spark, d):
    return _parts(spark, d).groupBy("part").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(f"SELECT event_id, part, round((value - m) / s, 6) AS z FROM ({PARTS}), (SELECT avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS s FROM ({PARTS}) WHERE part = 'training')")
def zscore_training_only(spark, d):
    p = _parts(spark, d).select("event_id", "part", "value")
    fit = p.where("part = 'training'").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return p.crossJoin(F.broadcast(fit)).select("event_id", "part", r6((F.col("value") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("z"))


@query(f"WITH g AS (SELECT part, avg(value) AS m, stddev_pop(value) AS s FROM ({PARTS}) GROUP BY part) SELECT g.part, round((g.m - t.m) / t.s, 6) AS shift, abs((g.m - t.m) / t.s) >= 0.5 AS notable FROM g, (SELECT * FROM g WHERE part = 'training') t")
def mean_shift(spark, d):
    g = _parts(spark, d).groupBy("part").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    t = g.where("part = 'training'").select(F.col("m").alias("tm"), F.col("s").alias("ts"))
    shift = (F.col("m") - F.col("tm")) / F.col("ts")
    return g.crossJoin(F.broadcast(t)).select("part", r6(shift).alias("shift"), (F.abs(shift) >= 0.5).alias("notable"))


@query(f"SELECT part, count(CASE WHEN value < lo THEN 1 END) AS below, count(CASE WHEN value > hi THEN 1 END) AS above, count(CASE WHEN abs((value - m) / s) > 2 THEN 1 END) AS beyond_2, count(CASE WHEN abs((value - m) / s) > 3 THEN 1 END) AS beyond_3 FROM (SELECT part, value FROM ({PARTS})), (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_pop(value) AS s FROM ({PARTS}) WHERE part = 'training') GROUP BY part")
def support_departures(spark, d):
    p = _parts(spark, d).select("part", "value")
    fit = p.where("part = 'training'").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = F.abs((F.col("value") - F.col("m")) / F.col("s"))
    return p.crossJoin(F.broadcast(fit)).groupBy("part").agg(F.count_if(F.col("value") < F.col("lo")).alias("below"), F.count_if(F.col("value") > F.col("hi")).alias("above"), F.count_if(z > 2).alias("beyond_2"), F.count_if(z > 3).alias("beyond_3"))


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.975), 6) AS p975, round(quantile_cont(value, 0.99), 6) AS p99, round(median(value) + 2 * mad(value), 6) AS median_2mad FROM events GROUP BY event_type")
def percentile_threshold(spark, d):
    e, shares = events(spark, d).select("event_type", "value"), {"p95": 0.95, "p975": 0.975, "p99": 0.99, "median": 0.5}
    p = percentiles(e, "value", shares, ["event_type"])
    apart = with_group(e, p.select("event_type", "median"), ["event_type"]).select("event_type", F.abs(F.col("value") - F.col("median")).alias("apart"))
    both = p.join(percentiles(apart, "apart", {"mad": 0.5}, ["event_type"]), "event_type")
    return both.select("event_type", r6("p95").alias("p95"), r6("p975").alias("p975"), r6("p99").alias("p99"), r6(F.col("median") + 2 * F.col("mad")).alias("median_2mad"))


THRESHOLDS = (350.0, 400.0, 425.0, 450.0, 475.0)


@query(f"SELECT t AS threshold, n, round(pct, 6) AS pct FROM (SELECT t, count(CASE WHEN value > t THEN 1 END) AS n, count(CASE WHEN value > t THEN 1 END) * 100.0 / count(*) AS pct FROM events, (VALUES {', '.join(f'(CAST({t} AS DOUBLE))' for t in THRESHOLDS)}) v(t) GROUP BY t) ORDER BY abs(pct - 2.5), t LIMIT 1")
def threshold_select(spark, d):
    cells = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("value") > t).alias("n"), (F.count_if(F.col("value") > t) * 100.0 / F.count("*")).alias("pct")) for t in THRESHOLDS]
    return events(spark, d).agg(F.array(*cells).alias("x")).select(F.inline("x")).orderBy(F.abs(F.col("pct") - 2.5), "threshold").limit(1).select("threshold", "n", r6("pct").alias("pct"))


RULES = [("p95", "percentile", 95.0), ("p97_5", "percentile", 97.5), ("p99", "percentile", 99.0), ("mad_1_5", "mad", 1.5), ("mad_2", "mad", 2.0), ("mad_2_5", "mad", 2.5)]


@query(
    "WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events), d AS (SELECT med, quantile_cont(abs(value - med), 0.5) AS mad FROM events, m GROUP BY med) "
    + " UNION ALL ".join(f"SELECT '{n}' AS rule, round({f'quantile_cont(value, {v / 100})' if k == 'percentile' else f'max(med + {v} * mad)'}, 6) AS threshold FROM events, d" for n, k, v in RULES)
)
def threshold_rules(spark, d):
    return candidate_thresholds(events(spark, d), RULES, "value").select("rule", r6("threshold").alias("threshold"))


@query("""WITH s AS (SELECT event_type AS run, user_id AS k, count(*) AS score FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT run, k, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2.0 AS mean_rank, row_number() OVER (PARTITION BY run ORDER BY score DESC, k) AS place FROM s)
SELECT a.run AS run_a, b.run AS run_b, round(corr(a.mean_rank, b.mean_rank), 6) AS spearman, count(CASE WHEN a.place <= 10 AND b.place <= 10 THEN 1 END) AS top_10, count(CASE WHEN a.place <= 20 AND b.place <= 20 THEN 1 END) AS top_20
FROM r a JOIN r b ON a.k = b.k AND a.run < b.run GROUP BY 1, 2""")
def rank_stability_pairs(spark, d):
    s = events(spark, d).where("user_id is not null").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("k")).agg(F.count("*").alias("score"))
    return rank_stability(s, "k", "run", "score").select(F.col("left").alias("run_a"), F.col("right").alias("run_b"), r6("spearman").alias("spearman"), F.col("top_10_overlap").alias("top_10"), F.col("top_20_overlap").alias("top_20"))


# --- evaluation, joins, sets --------------------------------------------------------------------


@query("SELECT tp, fp, tn, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 6) AS f1, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy FROM (SELECT count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS tp, count(CASE WHEN quality <> 1 AND toxic = 1 THEN 1 END) AS fp, count(CASE WHEN quality <> 1 AND toxic <> 1 THEN 1 END) AS tn, count(CASE WHEN quality = 1 AND toxic <> 1 THEN 1 END) AS fn FROM labels)")
def confusion_metrics(spark, d):
    c = confusion(table(spark, d, "labels"), "quality", "toxic")
    return c.select("tp", "fp", "tn", "fn", *(r6(n).alias(n) for n in ("precision", "recall", "f1", "accuracy")))


@query("WITH p AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 1.1 WHEN o_orderkey % 3 = 1 THEN o_totalprice - 1 ELSE o_totalprice END - o_totalprice AS delta FROM orders) SELECT count(*) AS n, count(CASE WHEN delta > 0 THEN 1 END) AS up, count(CASE WHEN delta < 0 THEN 1 END) AS down, count(CASE WHEN delta = 0 THEN 1 END) AS same, round(avg(delta), 4) AS mean_delta, round(max(abs(delta)), 4) AS largest FROM p")
def paired_delta(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey") % 3
    other = base.select("o_orderkey", F.when(k == 0, F.col("o_totalprice") * 1.1).when(k == 1, F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice")).alias("new"))
    both = paired(other, base, "o_orderkey").withColumn("score_delta", F.col("new") - F.col("o_totalprice_baseline"))
    return delta_summary(both).select("n", "up", "down", "same", F.round("mean", 4).alias("mean_delta"), F.round("largest", 4).alias("largest"))


@query("WITH t AS (SELECT event_type, user_id FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS n FROM events GROUP BY 1, 2) WHERE n <= 20) SELECT a.event_type AS a, b.event_type AS b, count(*) AS shared, round(count(*) / CAST(40 - count(*) AS DOUBLE), 6) AS jaccard FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2")
def topk_overlap_jaccard(spark, d):
    c = events(spark, d).groupBy("event_type", "user_id").agg(F.count("*").alias("c"))
    t = c.withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("c"), "user_id"))).where("n <= 20").select("event_type", "user_id")
    a, b = t.alias("a"), t.alias("b")
    j = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.event_type") < F.col("b.event_type")))
    return j.groupBy(F.col("a.event_type").alias("a"), F.col("b.event_type").alias("b")).agg(F.count("*").alias("shared")).select("a", "b", "shared", r6(F.col("shared") / (40 - F.col("shared"))).alias("jaccard"))


@query("SELECT count(*) AS n, count(CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 7 = 0 THEN 1 END) AS lost, count(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 1 END) AS extra FROM orders")
def partition_union_reconstruct(spark, d):
    """A union that leaves rows out and repeats others: both differences are found, with repeats counted."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    parts = [o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 = 1"), o.where("o_orderkey % 3 = 2 and o_orderkey % 7 <> 0"), o.where("o_orderkey % 3 = 0 and o_orderkey % 5 = 0")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    counts = o.exceptAll(union).agg(F.count("*").alias("lost")).crossJoin(union.exceptAll(o).agg(F.count("*").alias("extra")))  # one row each
    return o.agg(F.count("*").alias("n")).crossJoin(counts)


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS without_label, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS without_document")
def key_match_anti(spark, d):
    j = table(spark, d, "documents").select("doc_id", F.lit(1).alias("a")).join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("b")), "doc_id", "full_outer")
    return j.agg(F.count_if(F.col("b").isNull()).alias("without_label"), F.count_if(F.col("a").isNull()).alias("without_document"))


@query("SELECT sha256(text) AS digest, count(DISTINCT source) AS groups, count(*) AS n FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def cross_group_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")).agg(F.count_distinct("source").alias("groups"), F.count("*").alias("n")).where("groups > 1")


# --- detections, serving --------------------------------------------------------------------------


@query("WITH t AS (SELECT event_type, count(*) AS boxes, count(DISTINCT user_id) AS images FROM events GROUP BY 1) SELECT event_type, boxes, images, round(boxes * 100.0 / (SELECT sum(boxes) FROM t), 6) AS share, (SELECT max(boxes) / CAST(min(boxes) AS DOUBLE) >= 1.5 FROM t) AS imbalanced FROM t")
def class_balance(spark, d):
    from ..operators.vision import class_balance as balance

    return balance(events(spark, d), "event_type", "user_id").select("event_type", "boxes", "images", r6("share").alias("share"), "imbalanced")


@query("SELECT user_id, count(*) AS detections, round(max(value), 6) AS max_confidence, CASE WHEN count(CASE WHEN value > 100 THEN 1 END) = 0 THEN 'NO_DETECTION' WHEN count(CASE WHEN value > 100 AND event_type <> 'view' THEN 1 END) = 0 THEN 'CLEAN' ELSE 'ATTENTION' END AS condition FROM events GROUP BY user_id")
def condition_summary(spark, d):
    from ..operators.vision import condition

    seen = F.col("value") > 100
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("detections"), r6(F.max("value")).alias("max_confidence"), condition(F.count_if(seen), F.count_if(seen & (F.col("event_type") != "view"))).alias("condition"))


@query("SELECT event_id, event_id % 3 = 0 AS analysed, round(event_id / 5.0, 6) AS video_time, CASE WHEN event_id % 3 = 0 THEN count(CASE WHEN event_id % 3 = 0 THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS running FROM events")
def frame_stride_log(spark, d):
    hit = F.col("event_id") % 3 == 0
    return events(spark, d).select("event_id", hit.alias("analysed"), r6(F.col("event_id") / 5.0).alias("video_time"), F.when(hit, F.count(F.when(hit, 1)).over(by_user())).alias("running"))


@query("SELECT event_id, round(value - 400, 6) AS threshold_margin, CASE WHEN value > 400 THEN 'ALERT' ELSE 'NORMAL' END AS status FROM events")
def replay_status(spark, d):
    return events(spark, d).select("event_id", r6(F.col("value") - 400).alias("threshold_margin"), status(F.col("value"), 400.0).alias("status"))


@query()
def iforest_fit_score(spark, d):
    from ..operators.iforest import fit, score

    e = table(spark, d, "embeddings")
    x = [f"x{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    rows = e.select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(x)))
    return score(rows, fit(rows, x, "vec_id", seed=42), x).select("vec_id", "anomaly_score")


@query("SELECT vec_id, CAST(64 AS INTEGER) AS inside, true AS same_score FROM embeddings")
def iforest_sql_score(spark, d):
    """A fitted forest scored by expressions: every row in one leaf box of each tree, and the score that Arrow batches give."""
    from ..operators.iforest import fit, score, score_sql

    e = table(spark, d, "embeddings")
    x = [f"x{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    rows = e.select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(x)))
    forest = fit(rows, x, "vec_id", trees=64, seed=42)
    other = score(rows, forest, x).select("vec_id", F.col("anomaly_score").alias("_other"))
    found = score_sql(rows, forest, x, with_boxes=True).select("vec_id", "inside", "anomaly_score")
    return found.join(other, "vec_id").select("vec_id", "inside", (F.abs(F.col("anomaly_score") - F.col("_other")) < 1e-12).alias("same_score"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup_ext(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"), (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("long").alias("level"))

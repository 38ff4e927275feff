"""Queries that compare whole tables: digest trees, the cells in which they differ, joins of intervals, a cleaned table against its raw text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.ordering import positions
from ..operators import intervals, merkle, preprocess
from ..sources import operational
from ..sources.folders import stored
from .catalogue import query, table
from .telemetry import SQL14, telemetry

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_CELL = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _COLUMNS)


def _placed(spark, d):
    return positions(table(spark, d, "orders").select(*_COLUMNS), "o_orderkey")


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, sha256({_CELL}) AS h FROM orders),
b AS (SELECT 0 AS level, pos // 1024 AS node, count(*) AS n, sha256(string_agg(h, '' ORDER BY pos)) AS digest FROM r GROUP BY ALL),
u AS (SELECT 1 AS level, node // 64 AS node, sum(n) AS n, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM b GROUP BY node // 64)
SELECT level, node, CAST(n AS BIGINT) AS n, digest FROM (SELECT * FROM b UNION ALL SELECT * FROM u WHERE (SELECT count(*) FROM b) > 1)""")
def merkle_digests(spark, d):
    """The two lowest levels of the tree over all orders."""
    return merkle.merkle_tree(_placed(spark, d), _COLUMNS).where("level < 2")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_custkey, o_orderstatus FROM orders)
SELECT pos, 'o_custkey' AS column_name, CAST(o_custkey AS VARCHAR) AS left_value, CAST(o_custkey + 1 AS VARCHAR) AS right_value FROM r WHERE pos % 1999 = 7
UNION ALL SELECT pos, 'o_orderstatus', o_orderstatus, NULL FROM r WHERE pos % 4001 = 9 AND o_orderstatus IS NOT NULL""")
def merkle_difference(spark, d):
    """Orders against a copy with a few cells changed, found from the root down."""
    left = _placed(spark, d)
    right = left.withColumn("o_custkey", F.when(F.col("_pos") % 1999 == 7, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))).withColumn("o_orderstatus", F.when(F.col("_pos") % 4001 != 9, F.col("o_orderstatus")))
    return merkle.differing_cells(left, right, _COLUMNS)


def _spans(spark, d, flag):
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    day = lambda c: F.date_diff(F.to_date(c), F.lit("1992-01-01").cast("date")).cast("long")
    first = F.min(F.struct(day("l_shipdate").alias("lo"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("hi"), "l_suppkey")).alias("x")
    return rows.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item")).agg(first).select("item", "x.*")


_SPANS = "SELECT DISTINCT ON (item) l_orderkey * 10 + l_linenumber AS item, l_suppkey, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS lo, lo + CAST(l_quantity AS BIGINT) AS hi, l_returnflag AS flag FROM lineitem WHERE l_returnflag = '{}' ORDER BY item, lo, hi, l_suppkey"


@query(f"""WITH a AS ({_SPANS.format('R')}), b AS ({_SPANS.format('A')}) SELECT a.l_suppkey, a.item, count(*) AS n, min(b.item) AS first_item FROM a JOIN b ON a.l_suppkey = b.l_suppkey AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL""")
def interval_overlaps(spark, d):
    """Of each returned item, the items of its supplier whose time overlaps its own."""
    met = intervals.overlaps(_spans(spark, d, "R"), _spans(spark, d, "A"), ("lo", "hi"), ("lo", "hi"), ("item", "item"), ["l_suppkey"], unit=16)
    return met.groupBy("l_suppkey", F.col("left_item").alias("item")).agg(F.count("*").alias("n"), F.min("right_item").alias("first_item"))


@query(f"""WITH a AS ({_SPANS.format('R')}), b AS ({_SPANS.format('A')}) SELECT item, l_suppkey FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.l_suppkey = b.l_suppkey AND a.lo - 29 <= b.hi AND b.lo <= a.hi + 29)""")
def interval_gap(spark, d):
    """Returned items that keep 30 days from every other kind of item of their supplier."""
    return intervals.apart(_spans(spark, d, "R"), _spans(spark, d, "A"), ("lo", "hi"), ("lo", "hi"), ("item", "item"), ["l_suppkey"], gap=30, unit=16).select("item", "l_suppkey")


_CLEANED = ("Wind_Speed", "Solar_Radiation", "RTD_1")
_RANGES = " + ".join(f"CASE WHEN min({c}) = min({m}) AND max({c}) = max({m}) THEN 0 ELSE 1 END" for c, m in zip(_CLEANED, ("Wind_Speed + moved", *_CLEANED[1:])))


@query(f"""WITH r AS (SELECT *, event_id % 97 = 3 AS bad, event_id % 509 = 1 AS lost, CASE WHEN event_id % 311 = 0 THEN 1 ELSE 0 END AS moved FROM ({SQL14})),
p AS (SELECT *, row_number() OVER (ORDER BY bad, CASE WHEN bad THEN NULL ELSE "Timestamp" END, event_id) AS place FROM r),
c AS (SELECT count(CASE WHEN bad AND event_id % 50 = 0 THEN 1 END) AS again, count(CASE WHEN lost AND NOT bad THEN 1 END) AS more, CASE WHEN min(CASE WHEN bad OR lost THEN place END) < max(CASE WHEN NOT (bad OR lost) THEN place END) THEN 1 ELSE 0 END AS early, {_RANGES} AS ranges,
 count(CASE WHEN moved = 1 OR (lost AND NOT bad) THEN 1 END) AS content FROM p)
SELECT "check", CAST(violations AS BIGINT) AS violations FROM (SELECT 'parse_failures_differ' AS "check", abs(again - more) AS violations FROM c UNION ALL SELECT 'bad_timestamp_before_a_good_one', early FROM c UNION ALL SELECT 'ranges_differ', ranges FROM c
 UNION ALL SELECT 'content_differs', content FROM c UNION ALL SELECT unnest(['row_count_differs', 'columns_lost', 'required_columns_missing', 'columns_added', 'column_order_differs', 'timestamp_steps_back', 'raw_file_changed']), 0)""")
def cleaned_checks(spark, d):
    """The telemetry as raw text with repeated rows and bad timestamps, cleaned, then harmed on purpose: all eleven checks."""
    e, ts = F.col("event_id"), F.col(S.TIMESTAMP)
    texts = [F.when(e % 97 == 3, "bad").otherwise(F.date_format(ts, "d-M-yyyy H:m")).alias(S.TIMESTAMP), *(F.col(c).cast("string").alias(c) for c in _CLEANED), e.cast("string").alias("event_id")]
    own = telemetry(spark, d).select(*texts, e.alias("_pos"))
    raw = own.unionByName(own.where("_pos % 50 = 0").withColumn("_pos", F.col("_pos") + (1 << 50)))
    rows = stored(operational.typed(operational.drop_duplicates(raw), numeric=_CLEANED).withColumn("_late", ts.isNull()))
    rows = positions(rows.withColumn("_order", F.coalesce(ts, F.lit("9999-12-31 23:59:59").cast("timestamp_ntz"))), "_order", ["_late", "_pos"], name="_place")
    wind = F.col("Wind_Speed") + F.when(F.col("_pos") % 311 == 0, 1.0).otherwise(0.0)
    kept = F.when(F.col("_pos") % 509 != 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    clean = rows.select(kept.alias(S.TIMESTAMP), wind.cast("string").alias("Wind_Speed"), *(F.col(c).cast("string").alias(c) for c in _CLEANED[1:]), "event_id", F.col("_place").alias("_pos"))
    return preprocess.validate_cleaned(raw, clean, _CLEANED, [S.TIMESTAMP, *_CLEANED])

"""Profiles of telemetry tables: cadence, gaps, text that is no number, ranges, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import in_chunks, percentiles, positions
from ..functions.scalars import blank_to_null, parse_number
from ..functions.windows import seconds_between

#: Physical ranges: (what is wrong, predicate) by column; rows are flagged, never dropped.
RANGE_RULES = {
    "Air_Temp": ("below absolute zero", lambda c: c < -273.15), "Relative_Humidity": ("outside 0 to 100 %", lambda c: (c < 0) | (c > 100)), "Wind_Speed": ("below 0", lambda c: c < 0),
    "Wind_Direction": ("outside 0 to 360 degrees", lambda c: (c < 0) | (c > 360)), "Solar_Radiation": ("below 0", lambda c: c < 0), "Power_Generated": ("below 0", lambda c: c < 0),
}


def range_flags(df: DataFrame, rules: dict | None = None, pos: str | None = None) -> DataFrame:
    """column_name, rule, n, lo, hi (and the first ten places, with `pos`): rows outside each range, in one pass."""
    cells = []
    for c, (text, test) in (rules or RANGE_RULES).items():
        bad = F.coalesce(test(F.col(c)), F.lit(False))
        facts = [F.lit(c).alias("column_name"), F.lit(text).alias("rule"), F.count_if(bad).alias("n"), F.min(F.when(bad, F.col(c))).alias("lo"), F.max(F.when(bad, F.col(c))).alias("hi")]
        cells.append(F.struct(*facts))
    out = df.agg(F.array(*cells).alias("x")).select(F.inline("x"))
    if pos is None:
        return out
    long = df.select(pos, F.explode(F.array_compact(F.array(*(F.when(F.coalesce(test(F.col(c)), F.lit(False)), F.lit(c)) for c, (_, test) in (rules or RANGE_RULES).items())))).alias("column_name"))
    first = long.withColumn("_r", F.row_number().over(Window.partitionBy("column_name").orderBy(pos))).where("_r <= 10")  # cut before the shuffle
    return out.join(first.groupBy("column_name").agg(F.sort_array(F.collect_list(pos)).alias("first_places")), "column_name", "left")


def invalid_text(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, n, examples: cells that hold text but no number; the ten smallest distinct examples."""
    cells = [F.struct(F.lit(c).alias("column_name"), blank_to_null(F.col(c)).alias("text")) for c in columns]
    bad = raw.select(F.inline(F.array(*cells))).where(F.col("text").isNotNull() & parse_number(F.col("text")).isNull()).groupBy("column_name", "text").agg(F.count("*").alias("k"))
    few = bad.withColumn("_r", F.row_number().over(Window.partitionBy("column_name").orderBy("text"))).where("_r <= 10")
    n = bad.groupBy("column_name").agg(F.sum("k").alias("n"))
    return n.join(few.groupBy("column_name").agg(F.sort_array(F.collect_list("text")).alias("examples")), "column_name")


def infer_numeric_columns(raw: DataFrame, excluded: Sequence[str] = (), least_share: float = 0.95) -> list[str]:
    """Columns of text of which at least `least_share` of the cells that hold something are numbers."""
    columns = [c for c in raw.columns if c not in excluded]
    text = {c: blank_to_null(F.col(c)) for c in columns}
    row = raw.agg(*(F.avg(F.when(text[c].isNotNull(), parse_number(text[c]).isNotNull().cast("int"))).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] is not None and row[c] >= least_share]


def plain_name(column: str) -> str:
    return "".join(x for x in column.lower() if x.isalnum())


def infer_timestamp_column(columns: Sequence[str]) -> str:
    """The one column whose plain name is the best known name of a time, or else the only one that holds such a name."""
    plain = {c: plain_name(c) for c in columns}
    for wanted in ("timestamp", "datetime", "dateandtime", "date", "time"):
        if len(found := [c for c, p in plain.items() if p == wanted]) == 1:
            return found[0]
    if len(found := [c for c, p in plain.items() if "timestamp" in p or "datetime" in p]) == 1:
        return found[0]
    raise ValueError("no single column of timestamps; name one")


def find_column(columns: Sequence[str], *candidates: str) -> str | None:
    """The first column that equals a candidate but for case and punctuation."""
    plain = {plain_name(c): c for c in reversed(columns)}
    return next((plain[plain_name(c)] for c in candidates if plain_name(c) in plain), None)


def file_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """file, n, missing: rows and missing cells by file, from a table with `_file`."""
    gaps = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    return df.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("n"), F.sum(gaps).alias("missing"))


def cleaning_summary(raw: DataFrame, clean: DataFrame, numeric: Sequence[str], ts: str = "Timestamp") -> DataFrame:
    """One row a column: missing and unreadable before, missing after, range before and after."""
    cells = lambda df, read: [F.struct(F.lit(c).alias("column_name"), F.count_if(blank_to_null(F.col(c).cast("string")).isNull()).alias("missing"), F.count_if(blank_to_null(F.col(c).cast("string")).isNotNull() & read(c).isNull()).alias("unreadable"), F.min(read(c)).alias("lo"), F.max(read(c)).alias("hi")) for c in numeric]
    facts = lambda df, read: df.agg(F.array(*cells(df, read)).alias("x")).select(F.inline("x"))
    before = facts(raw, lambda c: parse_number(blank_to_null(F.col(c))))
    after = facts(clean, F.col)
    return before.join(after.select("column_name", F.col("missing").alias("missing_after"), F.col("lo").alias("lo_after"), F.col("hi").alias("hi_after")), "column_name")


def timestamp_profile(df: DataFrame, ts: str, pos: str | None = None, tolerance: float = 1.0) -> DataFrame:
    """One row: n, missing_timestamps, first, last, duplicates, backward, median/min/max gap, irregular, missing.

    Gaps are between distinct timestamps, in seconds; irregular ones differ from the median by more
    than `tolerance`; `missing` estimates the rows that long gaps leave out (half to even).
    `backward` counts steps back in the order of `pos`, null without it.
    """
    stats = df.agg(F.count("*").alias("n"), F.count_if(F.col(ts).isNull()).alias("missing_timestamps"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    times = df.where(F.col(ts).isNotNull()).groupBy(ts).agg(F.count("*").alias("_n"))
    repeated = times.agg(F.coalesce(F.sum("_n") - F.count("*"), F.lit(0)).alias("duplicates"))

    def step(rows: DataFrame, part: list[str]) -> DataFrame:
        return rows.withColumn("_gap", seconds_between(F.col(ts), F.lag(ts).over(Window.partitionBy(*part).orderBy("_pos"))))

    gaps = in_chunks(positions(times.select(ts), ts), 1, 0, step).where("_gap is not null").select("_gap")
    g = gaps.crossJoin(F.broadcast(percentiles(gaps, "_gap", {"median_gap": 0.5})))  # one row
    long = F.col("_gap") > F.col("median_gap") + tolerance
    measured = g.agg(
        F.max("median_gap").alias("median_gap"), F.min("_gap").alias("min_gap"), F.max("_gap").alias("max_gap"), F.count_if(F.abs(F.col("_gap") - F.col("median_gap")) > tolerance).alias("irregular"),
        F.coalesce(F.sum(F.when(long, F.greatest(F.bround(F.try_divide("_gap", "median_gap")) - 1, F.lit(0.0))).otherwise(0.0)), F.lit(0.0)).cast("long").alias("missing"),
    )
    back = df.agg(F.lit(None).cast("long").alias("backward"))
    if pos is not None:
        back = in_chunks(positions(df.select(ts, pos), pos, name="_at"), 1, 0, lambda rows, part: rows.withColumn("_back", F.col(ts) < F.lag(ts).over(Window.partitionBy(*part).orderBy("_at"))), pos="_at")
        back = back.agg(F.count_if("_back").alias("backward"))
    out = stats
    for one in (repeated, back, measured):  # one row each
        out = out.crossJoin(F.broadcast(one))
    return out.select("n", "missing_timestamps", "first", "last", "duplicates", "backward", "median_gap", "min_gap", "max_gap", "irregular", "missing")

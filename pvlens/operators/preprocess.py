"""The written result of the cleaning stage against the raw files: eleven checks, each a count that must be 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.ordering import positions, with_group
from ..functions.scalars import close
from ..sources import operational
from ..sources.folders import stored
from .freeze import touched

HELPERS = ("_pos", "_file")


def backward_steps(df: DataFrame, value: str, pos: str = "_pos", size: int = 1 << 16) -> DataFrame:
    """n: how many rows hold a value below that of an earlier row; null values are passed over, however many there are."""
    held = df.where(F.col(value).isNotNull()).select(F.col(pos).alias("_at"), F.col(value).alias("_value"), F.floor(F.col(pos) / F.lit(size)).alias("_part"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    tops = held.groupBy("_part").agg(F.max("_value").alias("_top")).select("_part", F.max("_top").over(before).alias("_top"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    seen = with_group(held, tops, ["_part"]).withColumn("_seen", F.greatest(F.max("_value").over(inside), F.col("_top")))
    return seen.agg(F.count_if(F.col("_value") < F.col("_seen")).alias("n"))


def _facts(df: DataFrame, ts: str, numeric: Sequence[str], prefix: str, pos: str) -> DataFrame:
    """One row: rows, rows without a timestamp, the last place with one and the first without, ranges."""
    ranges = [f(c).alias(f"{prefix}_{name}_{i}") for i, c in enumerate(numeric) for name, f in (("low", F.min), ("high", F.max))]
    missing = F.col(ts).isNull()
    return df.agg(
        F.count("*").alias(f"{prefix}_rows"), F.count_if(missing).alias(f"{prefix}_failures"), F.max(F.when(~missing, F.col(pos))).alias(f"{prefix}_last"), F.min(F.when(missing, F.col(pos))).alias(f"{prefix}_first"), *ranges,
    )


def differing_rows(expected: DataFrame, actual: DataFrame, columns: Sequence[str], numeric: Sequence[str], ts: str, pos: str = "_pos") -> DataFrame:
    """n: places at which the two tables differ. `expected` is put in the order of (timestamp, nulls last; pos); `actual` counts its rows from 0."""
    late = F.col(ts).isNull()
    ordered = expected.withColumn("_late", late).withColumn("_order", F.coalesce(ts, F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")))
    left = positions(ordered, "_order", ["_late", pos], name="_place").select(F.col("_place").alias("_key"), *(F.col(c).alias(f"_want_{i}") for i, c in enumerate(columns)))
    right = actual.select(F.col(pos).alias("_at"), *(F.col(c).alias(f"_have_{i}") for i, c in enumerate(columns)))
    differs = F.col("_key").isNull() | F.col("_at").isNull()
    for i, c in enumerate(columns):
        want, have = F.col(f"_want_{i}"), F.col(f"_have_{i}")
        differs = differs | ~(close(have, want, 1e-12, 1e-12) if c in numeric else have.eqNullSafe(want))
    return left.join(right, F.col("_key") == F.col("_at"), "full").agg(F.count_if(differs).alias("n"))


def validate_cleaned(raw: DataFrame, clean: DataFrame, numeric: Sequence[str] = tuple(S.MEASUREMENTS), required: Sequence[str] = tuple(S.S14), ts: str = S.TIMESTAMP, pattern: str = "d-M-yyyy H:m", out_pattern: str = "yyyy-MM-dd HH:mm:ss", pos: str = "_pos", before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """check, violations. raw, clean: the texts of both sides as read from their files, duplicates in `raw` included.

    before, after: snapshots of the raw files (`freeze.snapshot`); without them the files count as untouched. Timestamps
    that do not parse, missing ones included, must be as many as in `raw`: a repeated row with a bad one is a
    violation. Checks of a column that `clean` lacks count 1. Ranges are compared over all raw rows. Empty tables agree.
    """
    given, got = ([c for c in df.columns if c not in HELPERS] for df in (raw, clean))
    lost, added = [c for c in given if c not in got], [c for c in got if c not in given]
    shared = [c for c in numeric if c in given and c in got]
    # Both sides are read, told apart and parsed once; every check then reads the values.
    first = stored(operational.typed(operational.number_duplicates(raw, "_copy"), ts, shared, pattern))
    second = stored(operational.typed(clean, ts, shared, out_pattern))
    once = first.where("_copy = 1").drop("_copy")
    timed, whole = ts in got, not [c for c in required if c not in got]

    stand_in = second if timed else second.withColumn(ts, F.lit(None).cast("timestamp_ntz"))
    facts = _facts(first, ts, shared, "raw", pos).crossJoin(_facts(stand_in, ts, shared, "clean", pos)).crossJoin(once.agg(F.count("*").alias("kept")))  # one row each
    ranges = F.lit(len(numeric) - len(shared))
    for i in range(len(shared)):
        kept = close(F.col(f"clean_low_{i}"), F.col(f"raw_low_{i}")) & close(F.col(f"clean_high_{i}"), F.col(f"raw_high_{i}"))
        ranges = ranges + (~kept).cast("int")
    early = F.coalesce(F.col("clean_first") < F.col("clean_last"), F.lit(False)).cast("int")
    from_facts = {
        "row_count_differs": F.abs(F.col("clean_rows") - F.col("kept")), "columns_lost": F.lit(len(lost)), "required_columns_missing": F.lit(len([c for c in required if c not in got])),
        "columns_added": F.lit(len(added)), "column_order_differs": F.lit(int(given != got)), "parse_failures_differ": F.abs(F.col("clean_failures") - F.col("raw_failures")) if timed else F.lit(1),
        "bad_timestamp_before_a_good_one": early if timed else F.lit(1), "ranges_differ": ranges,
    }
    counts = facts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), c.cast("long").alias("violations")) for k, c in from_facts.items()))))
    one = lambda name, n: n.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("violations"))
    nothing = lambda n: raw.sparkSession.range(1).select(F.lit(n).alias("n"))
    out = counts.unionByName(one("timestamp_steps_back", backward_steps(second, ts, pos) if timed else nothing(0)))
    content = differing_rows(once, second, [c for c in given if c in got], shared, ts, pos) if whole else nothing(1)
    files = nothing(0) if before is None or after is None else touched(before, after).agg(F.count("*").alias("n"))
    return out.unionByName(one("content_differs", content)).unionByName(one("raw_file_changed", files))

"""Statistics of anomaly scores: by partition and context, against training, between models; scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import percentiles, time_buckets, with_ranks
from ..functions.scalars import close, corr
from ..functions.windows import micros, seconds_between
from .merkle import encoded
from .review import long_form

SHARES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p975": 0.975, "p99": 0.99}


def score_statistics(scores: DataFrame, by: str = "partition", score: str = "anomaly_score", training: str = "training") -> DataFrame:
    """One row a partition: n, mean, population deviation, range, percentiles, and the shift of its mean in training deviations."""
    s = F.col(score)
    facts = scores.groupBy(by).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("minimum"), F.max(s).alias("maximum"))
    base = facts.where(F.col(by) == training).select(F.col("mean").alias("_m"), F.col("std").alias("_s"))
    base = base.agg(F.max("_m").alias("_m"), F.max("_s").alias("_s"))  # one row, even without training rows
    out = facts.join(percentiles(scores, score, SHARES, [by]), by).crossJoin(F.broadcast(base))
    return out.withColumn("shift", F.try_divide(F.col("mean") - F.col("_m"), "_s")).drop("_m", "_s")


def context_statistics(scores: DataFrame, by: Sequence[str] = ("partition", "context"), score: str = "anomaly_score") -> DataFrame:
    s = F.col(score)
    facts = scores.groupBy(*by).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.max(s).alias("maximum"))
    return facts.join(percentiles(scores, score, {"median": 0.5}, by), list(by))


def fit_scaler(training: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, mean, std: population moments; a deviation of 0 counts as 1."""
    cells = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias("std")) for c in features]
    return training.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def scaled(df: DataFrame, scaler: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """df with the features scaled, in place or beside them under a suffix."""
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def scaler_values(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    return {r.feature: (r.mean, r.std) for r in scaler.collect()}  # one row a feature


def scaler_review(df: DataFrame, features: Sequence[str], by: str = "partition", training: str = "training") -> DataFrame:
    """by, column_name: mean, deviation and range, raw and in training deviations; how many rows lie outside the training range or beyond 2, 3, 5 deviations."""
    long = long_form(df, features, by)
    fit = long.where(F.col(by) == training).groupBy("column_name").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    z = (F.col("value") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    rows = long.join(F.broadcast(fit), "column_name").withColumn("z", z)  # one row a declared feature
    beyond = [F.count_if(F.abs("z") > k).alias(f"beyond_{k}") for k in (2, 3, 5)]
    return rows.groupBy(by, "column_name").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.avg("z").alias("scaled_mean"), F.stddev_pop("z").alias("scaled_std"), F.min("z").alias("scaled_min"), F.max("z").alias("scaled_max"),
        F.count_if(F.col("value") < F.col("_lo")).alias("below"), F.count_if(F.col("value") > F.col("_hi")).alias("above"), *beyond,
    )


def mean_shifts(statistics: DataFrame, by: str = "partition", training: str = "training", notable: float = 0.5) -> DataFrame:
    """Shift of each column's mean against training, in training deviations, largest first; statistics as from `scaler_review`."""
    base = statistics.where(F.col(by) == training).select("column_name", F.col("mean").alias("_m"), F.col("std").alias("_s"))
    shift = F.try_divide(F.col("mean") - F.col("_m"), "_s")
    out = statistics.where(F.col(by) != training).join(base, "column_name").select(by, "column_name", shift.alias("shift"), F.coalesce(F.abs(shift) >= notable, F.lit(False)).alias("notable"))
    return out.orderBy(F.desc(F.abs("shift")), by, "column_name")


def top_rows(scores: DataFrame, k: int = 10, by: Sequence[str] = ("partition",), score: str = "anomaly_score", ts: str = "Timestamp") -> DataFrame:
    """The k highest scores of each group, ties to the earlier row, with their place."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), ts)
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_summary(scores: DataFrame, k: int = 10, by: Sequence[str] = ("partition",), score: str = "anomaly_score", ts: str = "Timestamp", context: str = "context", minutes: int = 60) -> DataFrame:
    """by..., rows, span in hours, most of them in any `minutes`, rows in context (1): of the k highest scores."""
    width = minutes * 60_000_000
    top = top_rows(scores, k, by, score, ts).select(*by, ts, context, micros(F.col(ts)).alias("_us"))
    w = Window.partitionBy(*by, "_bucket").orderBy("_us").rangeBetween(0, width)
    dense = time_buckets(top, "_us", width, 0, 1).withColumn("_n", F.count("*").over(w)).where("_own").groupBy(*by).agg(F.max("_n").alias("most_in_window"))
    span = top.groupBy(*by).agg(F.count("*").alias("rows"), (seconds_between(F.max(ts), F.min(ts)) / 3600).alias("span_hours"), F.count_if(F.col(context) == 1).alias("in_context"))
    return span.join(dense, list(by))


def neighbour_means(df: DataFrame, at: DataFrame, columns: Sequence[str], ts: str = "Timestamp", minutes: float = 10, by: Sequence[str] = ()) -> DataFrame:
    """at with the means of `columns` over the rows within `minutes` of each of its rows, itself left out."""
    width = int(minutes * 60_000_000)
    at_us = micros(F.col(ts))
    rows = df.select(*by, at_us.alias("_us"), *columns).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_us") / width) - 1, F.floor(F.col("_us") / width) + 1)))
    own = at.withColumn("_at", at_us).withColumn("_bucket", F.floor(F.col("_at") / width))
    near = rows.select(*by, "_bucket", "_us", *(F.col(c).alias(f"_near_{c}") for c in columns))
    met = own.join(near, [*by, "_bucket"], "left").where(F.col("_us").isNull() | ((F.abs(F.col("_us") - F.col("_at")) <= width) & (F.col("_us") != F.col("_at"))))
    means = met.groupBy(*by, ts).agg(*(F.avg(f"_near_{c}").alias(f"{c}_near") for c in columns))
    return at.join(means, [*by, ts], "left")


def rank_changes(left: DataFrame, right: DataFrame, pick: Column, key: str = "Timestamp", score: str = "anomaly_score", by: Sequence[str] = ()) -> DataFrame:
    """One row: of the rows that `pick` takes (of left's columns), how far their ranks (1 is highest) move between two models."""
    ranked = lambda df, name: with_ranks(df, score, by, ("_mean", name, "_share")).drop("_mean", "_share")
    a = ranked(left, "rank_left").where(pick)
    b = ranked(right.select(*by, key, score), "rank_right").select(*by, F.col(key), "rank_right")
    moved = a.join(b, [*by, key]).select(F.abs(F.col("rank_left") - F.col("rank_right")).alias("moved"))
    facts = moved.agg(F.count("*").alias("n"), F.max("moved").alias("largest"), F.avg("moved").alias("mean"))
    return facts.crossJoin(percentiles(moved, "moved", {"median": 0.5}))  # one row each


def reproduction(saved: DataFrame, fresh: DataFrame, key: Sequence[str] = ("Timestamp",), score: str = "anomaly_score", tolerance: float = 1e-12) -> DataFrame:
    """One row: rows on both sides, rows on one side alone, largest difference, differences beyond the tolerance."""
    other = fresh.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)), F.col(score).alias("_fresh"))
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    gap = F.abs(F.col(score) - F.col("_fresh"))
    alone = F.col("_fresh").isNull() | F.col(score).isNull()
    return saved.select(*key, score).join(other, on, "full").agg(F.count_if(~alone).alias("matched"), F.count_if(alone).alias("unmatched"), F.max(gap).alias("largest"), F.count_if(gap > tolerance).alias("beyond"))


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows and a digest of the table that does not depend on the order of its rows; `merkle.merkle_tree` sees order.

    Each row's SHA-256, over an encoding that no other row shares, is cut into eight words; the sums of the words
    combine before the shuffle, so no task holds the table.
    """
    line = F.sha2(F.encode(encoded(df, columns), "UTF-8"), 256)
    words = [F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = [F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)]
    digest = F.sha2(F.encode(F.concat_ws("|", *(F.col(f"_w{i}").cast("string") for i in range(8))), "UTF-8"), 256)
    return df.agg(F.count("*").alias("rows"), *sums).select("rows", digest.alias("digest"))


def delta_summary(paired: DataFrame, delta: str = "score_delta", tolerance: float = 0.0) -> DataFrame:
    """One row: n, up, down, same, mean, range and the largest size of signed differences."""
    d = F.col(delta)
    return paired.agg(
        F.count(d).alias("n"), F.count_if(d > tolerance).alias("up"), F.count_if(d < -tolerance).alias("down"), F.count_if(F.abs(d) <= tolerance).alias("same"), F.avg(d).alias("mean"), F.min(d).alias("minimum"), F.max(d).alias("maximum"), F.max(F.abs(d)).alias("largest"),
    )


def agreement(left: DataFrame, right: DataFrame, columns: Sequence[str], key: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """left joined 1:1 to right, an error where a row has no partner or a shared column differs."""
    from .gates import demand

    other = right.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)), *(F.col(c).alias(f"_other_{c}") for c in columns), *(c for c in right.columns if c not in (*key, *left.columns)))
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    joined = left.join(other, on, "full")
    checks = {"unmatched": F.col("_key_0").isNull() | F.col(key[0]).isNull()} | {f"differs_{c}": ~close(F.col(c), F.col(f"_other_{c}"), 0.0, tolerance) for c in columns}
    demand(joined, checks)
    return joined.drop(*(f"_key_{i}" for i in range(len(key))), *(f"_other_{c}" for c in columns))


def safe_correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, Pearson and Spearman (mean ranks of ties) over complete rows; null where a side is constant."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    ranked = with_ranks(with_ranks(rows, "x", names=("rx", "_d1", "_s1")), "y", names=("ry", "_d2", "_s2"))
    return ranked.agg(F.count("*").alias("n"), corr(F.col("x"), F.col("y")).alias("pearson"), corr(F.col("rx"), F.col("ry")).alias("spearman"))

"""Order over whole tables without a task that sorts a whole table or a whole group.

A table is cut into blocks of ascending order values, at approximate quantiles; equal values share a
block. Blocks are sorted on their own and shifted by the totals of the blocks before, of which there
are at most `blocks` a group. Windows over neighbouring rows run in chunks of positions
that carry the rows before and after them along.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import micros


def with_group(df: DataFrame, facts: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """df with the columns of facts, which has one row a group; null groups match."""
    if not by:
        return df.crossJoin(F.broadcast(facts))  # one row
    named = facts.select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), *(c for c in facts.columns if c not in by))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    return df.join(named, same, how).drop(*(f"_by_{i}" for i in range(len(by))))


def blocked(df: DataFrame, order: str, by: Sequence[str] = (), blocks: int = 64, count: str | None = None) -> DataFrame:
    """df with _block: 0, 1, ... ascending in `order`, of about equal numbers of rows in each group; nulls are in block 0.

    count: a column of positive counts where df is an aggregate; the bounds read it too, so Spark shuffles the counts once and
    reuses that shuffle for bounds and rows instead of reading the input again.
    """
    value = F.col(order)
    if (kind := dict(df.dtypes)[order]).startswith("timestamp"):
        value = F.unix_micros(value) if kind == "timestamp" else micros(value)
    value = value.cast("double")
    df, value = df.withColumn("_cut_by", value), F.col("_cut_by")  # a column: inside the comparison below it would be computed again for every bound
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    sampled = value if count is None else F.when(F.col(count) > 0, value)
    bounds = df.groupBy(*by).agg(F.percentile_approx(sampled, shares, F.lit(20 * blocks)).alias("_bounds"))
    cut = F.when(value.isNull() | F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda b: b < value)))
    return with_group(df, bounds, by).withColumn("_block", cut.cast("int")).drop("_bounds", "_cut_by")


def distribution(df: DataFrame, value: str, by: Sequence[str] = (), blocks: int = 64) -> DataFrame:
    """by..., value, n, below, total: one row a distinct value that is not null, how often it comes, how many rows lie below it, and the rows of its group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    cut = blocked(counts, "value", by, blocks, "n")
    sums = cut.groupBy(*by, "_block").agg(F.sum("n").alias("_rows"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # at most `blocks` rows a group
    before = sums.select(*by, "_block", F.coalesce(F.sum("_rows").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_rows").over(w).alias("total"))
    inside = Window.partitionBy(*by, "_block").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return with_group(cut, before, [*by, "_block"]).select(*by, "value", "n", (F.col("_before") + F.col("_inside")).alias("below"), "total")


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """by..., one column a share: exact percentiles with linear interpolation, from the distribution; a group without values has no row."""
    picks = []
    for name, p in shares.items():
        at = F.lit(p) * (F.col("total") - 1)
        holds = lambda x: (F.col("below") <= x) & (x < F.col("below") + F.col("n"))
        lower, upper = F.max(F.when(holds(F.floor(at)), F.col("value"))), F.max(F.when(holds(F.ceil(at)), F.col("value")))
        rest = F.max(at) - F.floor(F.max(at))
        picks.append((lower + (upper - lower) * rest).alias(name))
    return distribution(df, value, by).groupBy(*by).agg(*picks)


def with_ranks(df: DataFrame, value: str, by: Sequence[str] = (), names: tuple[str, str, str] = ("rank_asc", "rank_desc", "share")) -> DataFrame:
    """df with the mean rank of ties (ascending), the least rank (descending) and the share of rows at or below; null values have none."""
    d = distribution(df, value, by)
    n, below, total = F.col("n"), F.col("below"), F.col("total")
    ranks = d.select(*by, F.col("value").alias(value), (below + (n + 1) / 2).alias(names[0]), (total - below - n + 1).alias(names[1]), ((below + n) / total).alias(names[2]))
    return with_group(df, ranks, [*by, value])


def positions(df: DataFrame, order: str, ties: Sequence[str] = (), by: Sequence[str] = (), name: str = "_pos", blocks: int = 64) -> DataFrame:
    """df with the place of each row in its group, from 0, by `order` (nulls first), then `ties`."""
    cut = blocked(df, order, by, blocks)
    sums = cut.groupBy(*by, "_block").agg(F.count("*").alias("_rows"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # at most `blocks` rows a group
    before = sums.select(*by, "_block", F.coalesce(F.sum("_rows").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_block").orderBy(order, *ties)
    placed = cut.withColumn("_inside", F.row_number().over(inside) - 1)
    return with_group(placed, before, [*by, "_block"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_block", "_inside", "_before")


def in_chunks(df: DataFrame, back: int, ahead: int, step: Callable[[DataFrame, list[str]], DataFrame], by: Sequence[str] = (), pos: str = "_pos", size: int = 1 << 16) -> DataFrame:
    """step(rows, partition columns), where a window ordered by `pos` sees `back` rows before and `ahead` rows after each row.

    Rows near the edge of a chunk are copied to its neighbours; copies are dropped afterwards.
    """
    first, last = F.floor((F.col(pos) - ahead) / F.lit(size)), F.floor((F.col(pos) + back) / F.lit(size))
    copied = df.withColumn("_chunk", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), first), last)))
    return step(copied, [*by, "_chunk"]).where(F.col("_chunk") == F.floor(F.col(pos) / F.lit(size))).drop("_chunk")


def numbered_runs(df: DataFrame, starts: Callable[[Callable[[Column], Column]], Column], by: Sequence[str] = (), pos: str = "_pos", name: str = "_run", size: int = 1 << 16) -> DataFrame:
    """df with the number of its run, from 1: starts(previous) says, of each row, whether a run begins there."""

    def mark(rows: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(pos)
        begins = (F.col(pos) == 0) | F.coalesce(starts(lambda c: F.lag(c).over(w)), F.lit(True))
        return rows.withColumn("_begins", begins.cast("int"))

    marked = in_chunks(df, 1, 0, mark, by, pos, size).withColumn("_part", F.floor(F.col(pos) / F.lit(size)))
    sums = marked.groupBy(*by, "_part").agg(F.sum("_begins").alias("_runs"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row a chunk
    before = sums.select(*by, "_part", F.coalesce(F.sum("_runs").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_part").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("_inside", F.sum("_begins").over(inside))
    return with_group(counted, before, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_begins", "_part", "_inside", "_before")


def time_buckets(df: DataFrame, micros: str, width: int, before: int, after: int) -> DataFrame:
    """df with _bucket and _own: each row in its bucket of `width` microseconds, and as a copy where a range frame needs it.

    before, after: how many buckets further a frame of another row may begin or end.
    """
    own = F.floor(F.col(micros) / F.lit(width))
    copied = df.withColumn("_bucket", F.explode(F.sequence(own - after, own + before)))
    return copied.withColumn("_own", F.col("_bucket") == own)


def counts_ahead(df: DataFrame, micros: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """by..., micros, n: of each distinct time, how many rows of its group lie from it to `width` microseconds later, both ends included.

    One running count a bucket, of equal times added up before: work in proportion to the rows, however many a frame holds.
    A time's count is what has come by its frame's end less what came before it. Null times have no row.
    """
    us = F.col(micros)
    times = df.where(us.isNotNull()).groupBy(*by, us.alias("_us")).agg(F.count("*").alias("_rows"))
    own = F.floor(F.col("_us") / F.lit(width))
    mark = lambda bucket, at, rows, sign: F.struct(bucket.alias("_bucket"), at.alias("_at"), rows.alias("_rows"), F.lit(sign).alias("_sign"))
    # A point begins its own frame (-1), as a copy it fills those of the bucket before (0); a frame's end (1) comes after the points of its time.
    marks = F.inline(F.array(mark(own, F.col("_us"), F.col("_rows"), -1), mark(own - 1, F.col("_us"), F.col("_rows"), 0), mark(own, F.col("_us") + width, F.lit(0).cast("long"), 1)))
    w = Window.partitionBy(*by, "_bucket").orderBy("_at", "_sign").rowsBetween(Window.unboundedPreceding, 0)
    run = times.select(*by, "_us", marks).withColumn("_come", F.sum("_rows").over(w))
    part = F.when(F.col("_sign") == 1, F.col("_come")).otherwise(F.col("_rows") - F.col("_come"))
    return run.where("_sign <> 0").groupBy(*by, "_bucket", F.col("_us").alias(micros)).agg(F.sum(part).alias("n")).drop("_bucket")

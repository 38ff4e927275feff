"""Joins of intervals with both sides large: overlap, containment of points, and the anti-join with a least gap.

Each interval is cut into cells of a nested binary grid: a long interval takes a few wide cells, a short one
a narrow cell or two, so its rows do not grow with its length. Two intervals that meet share a point, and of
the cells that hold this point one side's is inside the other's; every row looks for its own cell and for the
wider ones above it. Keys are (group, level, cell), so the join is by equality. Keys with many rows on both
sides are split by salts, chosen from their counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the grid: cells of 2^0 .. 2^62 units of the smallest width.
LEVELS = 40


def _level(lo: Column, hi: Column) -> Column:
    """The smallest level whose cells are as wide as [lo, hi], so that it touches at most two of them; lo, hi in units."""
    width = hi - lo + 1
    return F.least(F.lit(LEVELS), F.ceil(F.log2(width.cast("double"))).cast("int"))


def _unit(c: Column, unit: int) -> Column:
    return F.floor(c / F.lit(unit)).cast("long")


def _cells(df: DataFrame) -> DataFrame:
    """df with _cell: a row for each of the (one or two) cells of level _level that an interval touches."""
    cells = df.withColumn("_cell", F.explode(F.sequence(F.expr("shiftright(_u, _level)"), F.expr("shiftright(_v, _level)"))))
    return cells.drop("_u", "_v")


def _above(df: DataFrame, other: DataFrame, own: bool) -> DataFrame:
    """df at every wider level that the other side uses and, with own, at its own if that is used."""
    used = F.array(*(F.lit(r[0]) for r in other.select("_level").distinct().sort("_level").collect())).cast("array<int>")  # at most LEVELS numbers
    lifted = df.select("*", F.explode(F.filter(used, lambda x: x >= F.col("_level") if own else x > F.col("_level"))).alias("_up"))
    return lifted.drop("_level").withColumnRenamed("_up", "_level")


def _salted(left: DataFrame, right: DataFrame, on: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with _salt: where a key has over `most` rows on the left, they are dealt to salts and the right's rows copied to each.

    Keys are counted only in groups with over `most` rows. Of such groups and keys there is at most one for `most` rows, so they are broadcast.
    """
    large = left.groupBy(on[0]).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(on[0])
    held = left.join(F.broadcast(large), on[0], "left_semi")
    heavy = F.broadcast(held.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*on, F.ceil(F.col("_n") / F.lit(most)).cast("int").alias("_salts")))
    count = F.coalesce("_salts", F.lit(1))
    dealt = left.join(heavy, list(on), "left").withColumn("_salt", F.pmod(F.xxhash64("_lid"), count).cast("int")).drop("_salts")
    copied = right.join(heavy, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), count - 1))).drop("_salts")
    return dealt, copied


def overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], ids: tuple[str, str], by: Sequence[str] = (), gap: int = 0, unit: int = 1, most: int = 1 << 16) -> DataFrame:
    """by..., the ids of every pair of intervals that meet or are less than `gap` apart; ends are whole numbers and belong to their interval.

    ids name a unique column on each side. An interval whose ends are null or in the wrong order meets nothing;
    null groups meet each other. unit is the width of the narrowest cell: about that of a short interval.
    With gap = 0 intervals must share a point; with a gap g they may be up to g - 1 apart.
    """
    wide = max(0, gap - 1)
    a = left.where(F.col(left_span[0]) <= F.col(left_span[1])).select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), F.col(ids[0]).alias("_lid"), (F.col(left_span[0]) - wide).cast("long").alias("_lo"), (F.col(left_span[1]) + wide).cast("long").alias("_hi"))
    b = right.where(F.col(right_span[0]) <= F.col(right_span[1])).select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), F.col(ids[1]).alias("_rid"), F.col(right_span[0]).cast("long").alias("_from"), F.col(right_span[1]).cast("long").alias("_to"))
    group = range(len(by))
    key = [(F.xxhash64(*(f"_by_{i}" for i in group)) if by else F.lit(0).cast("long")).alias("_group")]
    a, b = (x.select("*", *key, _unit(F.col(lo), unit).alias("_u"), _unit(F.col(hi), unit).alias("_v")).withColumn("_level", _level(F.col("_u"), F.col("_v"))) for x, lo, hi in ((a, "_lo", "_hi"), (b, "_from", "_to")))
    on = ["_group", "_level", "_cell"]
    met = None
    # The left in its own cells meets the right lifted to them, and the other way round for wider cells of the right. A pair counts
    # in the cell that holds the first point it shares, so it is found once.
    first = F.expr("shiftright(_shared, _level)") == F.col("_cell")
    for x, y in ((a, _above(b, a, True)), (_above(a, b, False), b)):
        dealt, copied = _salted(_cells(x), _cells(y).withColumnsRenamed({f"_by_{i}": f"_other_{i}" for i in group}), on, most)
        meet = (F.col("_lo") <= F.col("_to")) & (F.col("_from") <= F.col("_hi"))
        for i in group:  # hashes of groups may agree
            meet = meet & F.col(f"_by_{i}").eqNullSafe(F.col(f"_other_{i}"))
        both = dealt.join(copied, [*on, "_salt"]).where(meet).withColumn("_shared", _unit(F.greatest("_lo", "_from"), unit))
        pairs = both.where(first).select(*(f"_by_{i}" for i in group), "_lid", "_rid")
        met = pairs if met is None else met.unionByName(pairs)
    return met.select(*(F.col(f"_by_{i}").alias(c) for i, c in enumerate(by)), F.col("_lid").alias(ids[0] if ids[0] != ids[1] else f"left_{ids[0]}"), F.col("_rid").alias(ids[1] if ids[0] != ids[1] else f"right_{ids[1]}"))


def apart(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], ids: tuple[str, str], by: Sequence[str] = (), gap: int = 0, unit: int = 1) -> DataFrame:
    """The rows of left that keep at least `gap` from every interval of right (and, with gap = 0, share no point with any)."""
    near = overlaps(left, right, left_span, right_span, ids, by, gap, unit)
    name = ids[0] if ids[0] != ids[1] else f"left_{ids[0]}"
    return left.join(near.select(F.col(name).alias(ids[0])).distinct(), ids[0], "left_anti")


def within(points: DataFrame, spans: DataFrame, at: str, span: tuple[str, str], ids: tuple[str, str], by: Sequence[str] = (), unit: int = 1) -> DataFrame:
    """by..., the ids of every point and every interval that holds it."""
    return overlaps(points, spans, (at, at), span, ids, by, 0, unit)

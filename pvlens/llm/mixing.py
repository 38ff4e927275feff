"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Source s asks for words at rate r_s(t) = target_s * (1 + tilt_s * (2 t - 1)) over training
time t in [0, 1]. Its integral C_s(t) = target_s * (t + tilt_s * (t^2 - t)) ends at the
target, and inverting it gives the time at which the c-th word of the source is due:
t = 2u / (q + sqrt(q^2 + 4 tilt u)), with u = c / target and q = 1 - tilt.
Documents queue in a hash order inside their source, over and over up to `max_repeats`
passes; a document takes part as far as its words lie below the target.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """source, source_size, turn, weight, target from (source, source_size), one row a source.

    Sources in code-point order, null last, take the weights in turn. The level L with
    sum(min(L * weight, cap)) = share * total is found by sorting sources by cap / weight: the
    first source that stays below its cap, when all before it are full, fixes L. Only one row
    a source reaches the global windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    full = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    demand = F.sum("source_size").over(every) * F.lit(float(share))
    before = F.coalesce(F.sum("_cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("_level", (demand - before) / rest).withColumn("_fits", F.col("_level") <= F.col("_ratio"))
    found = F.min(F.when(F.col("_fits"), F.struct("_ratio", "_level"))).over(every)["_level"]
    target = F.when(F.col("_cap") <= 0, F.lit(0.0)).when(found.isNull(), F.col("_cap")).otherwise(F.least(found * F.col("weight"), F.col("_cap")))
    return level.select("source", "source_size", "turn", "weight", target.alias("target"))


def due(consumed: Column, target: Column, tilt: Column) -> Column:
    """Training time in [0, 1] at which a source's demand reaches `consumed` words; 0 of a source that asks for none."""
    u, q = F.coalesce(F.try_divide(consumed, target), F.lit(0.0)), 1 - tilt
    root = q + F.sqrt(q * q + 4 * tilt * u)
    return F.when(root > 0, F.least(F.lit(1.0), 2 * u / root)).otherwise(F.lit(0.0))


def curriculum(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2, tilts: Sequence[float] = (-0.5, 0.0, 0.5), rows_per_bucket: int = 1 << 13, seed: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, takes, kept columns.

    Sources take weights and tilts in turn.

    takes: array of (pass, words, position), one for each pass that uses the document; taken
    is the sum of its words. A source takes round(target) words exactly: the document across
    the target is taken in part. Null texts and texts without words have size 0 and take
    nothing; null sources are a source of their own; repeated rows count each; an empty table
    gives no rows. A source without words has target 0 and takes nothing. A kept column of a name
    above comes back with the suffix _kept. Prefix sums run inside (source, hash bucket), shifted by the bucket totals
    before, so a hot source is spread over many tasks; rows without an id are spread by their text.
    """
    own = ("doc_id", "source", "size", "source_size", "target", "taken", "takes")
    held = {c: f"_keep_{i}" for i, c in enumerate(keep)}
    buckets = max(1, math.ceil(docs.select("doc_id").count() / rows_per_bucket))
    key = F.col("doc_id").cast("long")
    order = F.when(key.isNull(), F.xxhash64("text", F.lit(seed), F.lit("queue"))).otherwise(F.xxhash64(key, F.lit(seed), F.lit("queue")))
    sized = docs.select(
        key.alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("_order"),
        *(F.col(c).alias(name) for c, name in held.items()),
    ).select("*", F.pmod("_order", F.lit(buckets)).cast("int").alias("_bucket"))
    totals = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifted = totals.select("source", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_shift"))
    goal = targets(totals.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, max_repeats)
    plan = shifted.alias("a").join(goal.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.source_size", "b.turn", "b.target")
    tie = ["doc_id", "size", *[name for c, name in held.items() if c == "text"]]
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", *tie).rowsBetween(Window.unboundedPreceding, -1)
    queued = sized.withColumn("_inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = (
        queued.alias("q")
        .join(plan.alias("p"), F.col("q.source").eqNullSafe(F.col("p.source")) & (F.col("q._bucket") == F.col("p._bucket")))
        .select("q.*", "p.source_size", "p.turn", "p.target", (F.col("_shift") + F.col("_inner")).alias("_at"))
    )
    tilt = F.element_at(F.array(*[F.lit(float(t)) for t in tilts]), (F.pmod(F.col("turn"), F.lit(len(tilts))) + 1).cast("int"))
    goal_words = F.round("target").cast("long")
    takes = []
    for p in range(max_repeats):
        start = F.col("_at") + F.col("source_size") * p
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal_words - start))
        at = due(start + words / 2, F.col("target"), tilt)
        takes.append(F.struct(F.lit(p).alias("pass"), words.alias("words"), at.alias("position")))
    return joined.withColumn("takes", F.filter(F.array(*takes), lambda x: x["words"] > 0)).select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        "takes", *(F.col(name).alias(f"{c}_kept" if c in own else c) for c, name in held.items()),
    )


def schedule(mixed: DataFrame) -> DataFrame:
    """One row for each use of a document, range-sorted by training position."""
    uses = mixed.select("*", F.explode("takes").alias("_use")).drop("takes")
    flat = uses.select(*[c for c in uses.columns if c != "_use"], F.col("_use.pass").alias("pass"), F.col("_use.words").alias("words"), F.col("_use.position").alias("position"))
    return flat.repartitionByRange("position", "doc_id", "pass").sortWithinPartitions("position", "doc_id", "pass")

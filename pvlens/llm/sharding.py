"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

A row descends from the root: at each node every child draws -ln(u) / weight, where weight is
the sum of its subtree and u a hash of (key, level, child), and the smallest draw wins. So a
shard takes rows in proportion to its weight. A draw depends on its own subtree's weight alone:
where weights in a subtree grow, rows move into that subtree only, and below it only into the
children whose weights grew or, for rows new to it, where their draws lead. A shard that opens
a rack and region of its own takes rows only into itself. Everything is a DataFrame expression;
only (key, size, crc) rows are shuffled, once, to number the slots.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n_shards: int, shards_per_rack: int = 4, racks_per_region: int = 2, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Leaves 0..n-1 in racks and regions of fixed size; a leaf's place never depends on n."""
    per_region = shards_per_rack * racks_per_region
    weights = weights or {}
    return [Leaf(i // per_region, i // shards_per_rack, i, weights.get(i, 1.0)) for i in range(n_shards)]


def _pick(key: Column, children: list[tuple[int, float]], level: int, seed: int) -> Column:
    """The child whose draw -ln(u) / weight is smallest; u is a hash of (key, level, child)."""
    draws = []
    for child, weight in children:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child), F.lit(seed)), 11)
        draw = -F.log((bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(float(weight))
        draws.append(F.struct(draw.alias("draw"), F.lit(child).alias("child")))
    return (draws[0] if len(draws) == 1 else F.least(*draws))["child"]


def descend(rows: DataFrame, key: Column, leaves: list[Leaf], names: tuple[str, str, str], seed: int = 0) -> DataFrame:
    """rows with the region, rack and shard that key reaches from the root, in columns `names`.

    One pick a level among the children of the node reached, by the summed weights of their
    subtrees; only the draws of that node are computed.
    """
    live = [x for x in leaves if x.weight > 0]
    paths = {0: lambda x: (), 1: lambda x: (x.region,), 2: lambda x: (x.region, x.rack)}
    steps = {0: lambda x: x.region, 1: lambda x: x.rack, 2: lambda x: x.shard}
    for level in range(3):
        nodes: dict[tuple, dict[int, float]] = {}
        for x in live:
            own = nodes.setdefault(paths[level](x), {})
            own[steps[level](x)] = own.get(steps[level](x), 0.0) + x.weight
        found = None
        for path, children in sorted(nodes.items()):
            picked = _pick(key, sorted(children.items()), level, seed)
            if not path:
                found = picked
                continue
            here = F.col(names[level - 1]) == path[-1]
            if level == 2:
                here = here & (F.col(names[0]) == path[0])
            found = F.when(here, picked) if found is None else found.when(here, picked)
        rows = rows.withColumn(names[level], found)
    return rows


def shard_documents(docs: DataFrame, n_shards: int = 16, grow_to: int | None = None, seed: int = 0, rows_per_bucket: int = 1 << 16, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot, grown_shard for each row of docs.

    The law is `key`: doc_id and the shard count decide. Null ids share one key, null texts
    have no bytes, repeated rows go to the same shard with slots of their own, an empty table
    gives no rows, other columns are ignored. Slots are gapless from 0 in each shard: rows are
    numbered inside (shard, hash bucket) and shifted by the buckets before, so that no task
    sorts a whole shard.
    """
    grow_to = grow_to or n_shards + 1
    # A pruned scan of one column; the number of buckets follows the number of rows.
    buckets = max(1, math.ceil(docs.select("doc_id").count() / rows_per_bucket / n_shards))
    key = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(key, F.lit("slot"), F.lit(seed)), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    here, grown = topology(n_shards, weights=weights), topology(grow_to, weights=weights)
    rows = descend(rows, F.col("doc_id"), here, ("region", "rack", "shard"), seed)
    rows = descend(rows, F.col("doc_id"), grown, ("_region", "_rack", "grown_shard"), seed)
    keys = docs.select(key.alias("doc_id"), F.pmod(F.xxhash64(key, F.lit("slot"), F.lit(seed)), F.lit(buckets)).cast("int").alias("_bucket"))
    tree = descend(keys, F.col("doc_id"), here, ("region", "rack", "shard"), seed)
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tree.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .join(offsets, ["shard", "_bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_row") - 1).alias("slot"), "grown_shard", "region", "rack")
    )

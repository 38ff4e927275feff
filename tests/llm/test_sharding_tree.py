"""The hash tree against a second implementation, and where rows move when weights change."""

import math
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from pvlens.llm import sharding

N = 4000


def spark_hash(*values):
    """xxhash64 of Spark over longs (int) and ints ((int,)): the hash so far seeds the next."""
    seed = 42
    for v in values:
        raw = struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def draw(key, level, child, weight):
    u = ((spark_hash(key, (level,), (child,), (0,)) >> 11) + 0.5) * 2.0**-53
    return -math.log(u) / weight


def reached(key, leaves):
    live = [x for x in leaves if x.weight > 0]
    for level, step in enumerate((lambda x: x.region, lambda x: x.rack, lambda x: x.shard)):
        weights = {}
        for x in live:
            weights[step(x)] = weights.get(step(x), 0.0) + x.weight
        best = min(weights, key=lambda c: (draw(key, level, c, weights[c]), c))
        live = [x for x in live if step(x) == best]
    return live[0].shard


@pytest.fixture(scope="module")
def docs(spark):
    return spark.range(N).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))


def placed(docs, weights=None, **options):
    return {r.doc_id: r for r in sharding.shard_documents(docs, weights=weights, **options).collect()}


@pytest.mark.parametrize("weights", [None, {3: 3.0, 9: 0.0, 14: 0.25}])
def test_same_as_descending_by_hand(docs, weights):
    got = placed(docs, weights)
    here, grown = sharding.topology(16, weights=weights), sharding.topology(17, weights=weights)
    assert all(r.shard == reached(i, here) and r.grown_shard == reached(i, grown) for i, r in got.items())
    assert all(r.region == r.shard // 8 and r.rack == r.shard // 4 for r in got.values())


def test_moves_stay_in_the_subtree_that_grew(docs):
    even = placed(docs)
    heavy = placed(docs, {5: 4.0})
    for i, r in even.items():
        a, b = r.shard, heavy[i].shard
        if a != b:
            assert b // 8 == 0  # only into the region of shard 5
            if a // 8 == 0:
                assert b // 4 == 1  # inside it, only into its rack
                if a // 4 == 1:
                    assert b == 5  # inside that, only into the shard
    share = sum(r.shard == 5 for r in heavy.values()) / N
    assert abs(share - 4 / 19) < 0.03


def test_a_shard_more_takes_rows_only_into_itself(docs):
    got = placed(docs)
    assert all(r.grown_shard in (r.shard, 16) for r in got.values())
    assert abs(sum(r.grown_shard == 16 for r in got.values()) / N - 1 / 17) < 0.02

"""Digest trees: order, encoding, the cell that differs, tables of other lengths, and the plain digest."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from pvlens.operators import merkle

SCHEMA = "_pos long, a string, b string"


def root(df, **k):
    tree = merkle.merkle_tree(df, ["a", "b"], **k).collect()
    top = max(r.level for r in tree)
    (r,) = [r for r in tree if r.level == top]
    return r.digest, r.n


def test_injective_and_ordered(spark):
    tables = [[("a|b", "c")], [("a", "b|c")], [(None, "c")], [("~", "c")], [("-", "c")], [("", "c")], [("a", "b"), ("c", "d")], [("c", "d"), ("a", "b")], [("1:a", None)], [("1", ":a")]]
    digests = [root(spark.createDataFrame([(i, *r) for i, r in enumerate(t)], SCHEMA)) for t in tables]
    assert len({d for d, _ in digests}) == len(tables)
    assert [n for _, n in digests] == [len(t) for t in tables]
    same = spark.createDataFrame([(1, "c", "d"), (0, "a", "b")], SCHEMA).repartition(3)
    assert root(same) == digests[6]


def test_the_cell_is_found(spark):
    left = spark.range(1000).select(F.col("id").alias("_pos"), F.col("id").cast("string").alias("a"), F.when(F.col("id") % 7 > 0, F.lit("x")).alias("b"))
    right = left.withColumn("b", F.when(F.col("_pos").isin(123, 700), F.lit("y")).otherwise(F.col("b"))).withColumn("a", F.when(F.col("_pos") == 700, F.lit("q")).otherwise(F.col("a")))
    trees = [merkle.merkle_tree(t, ["a", "b"], size=10, fan=4) for t in (left, right)]
    assert max(r.level for r in trees[0].collect()) == 4
    assert sorted(r.node for r in merkle.differing_blocks(*trees, fan=4).collect()) == [12, 70]
    got = sorted(tuple(r) for r in merkle.differing_cells(left, right, ["a", "b"], size=10, fan=4).collect())
    assert got == [(123, "b", "x", "y"), (700, "a", "700", "q"), (700, "b", None, "y")]
    shorter = left.where("_pos < 37")
    got = merkle.differing_cells(shorter, left, ["a", "b"], size=10, fan=4)
    assert sorted(r.pos for r in got.collect()) == list(range(37, 1000))
    assert merkle.differing_cells(left, left, ["a", "b"], size=10, fan=4).count() == 0
    assert merkle.merkle_tree(left.limit(0), ["a", "b"]).count() == 0
    assert merkle.differing_cells(left.limit(0), shorter, ["a", "b"], size=10, fan=4).count() == 37


def test_plain_digest(spark):
    rows = [(dt.datetime(2022, 5, 1, 0, 2 * i), x) for i, x in enumerate([0.1, 1 / 3, 1e-7, 2.0, 123456789.123, None])]
    lines = "".join(f"{t:%Y-%m-%d %H:%M:%S}|{'' if x is None else format(x, '.17g')}\n" for t, x in rows)
    df = spark.createDataFrame(rows[::-1], "Timestamp timestamp_ntz, anomaly_score double")
    assert merkle.score_digest(df) == hashlib.sha256(lines.encode()).hexdigest()


def test_order_blind_digest_is_injective(spark):
    from pvlens.operators import scores

    of = lambda *rows: scores.table_digest(spark.createDataFrame(list(rows), "a string, b string"), ["a", "b"]).first()
    assert len({of(r).digest for r in (("a|b", "c"), ("a", "b|c"), (None, "c"), ("~", "c"), ("-", "c"))}) == 5
    assert of(("a", "b"), ("c", "d")) == of(("c", "d"), ("a", "b")) and of(("a", "b")).rows == 1

"""Digests that see order and say where two tables differ: a tree of hashes over blocks of positions.

A row's hash is over an encoding that no other row shares (nulls marked, lengths written). A block's hash is
over its rows' hashes in order, a node's over its children's. Two tables are compared from the root down,
so only the blocks that differ are read row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import working_folder


@F.pandas_udf(T.StringType())
def seventeen_digits(x: pd.Series) -> pd.Series:
    """17 significant digits, which tell all doubles apart; null stays null."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.17g}")


def encoded(df: DataFrame, columns: Sequence[str]) -> Column:
    """A text for each row that only an equal row has: per column `-` for null, else length, colon and value.

    Doubles count with the bits that their shortest text has; -0.0 and 0.0 are two values.
    """
    cell = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat(*(cell(c) for c in columns))


def merkle_tree(df: DataFrame, columns: Sequence[str], pos: str = "_pos", size: int = 1024, fan: int = 64) -> DataFrame:
    """level, node, n, digest: blocks of `size` positions (level 0) up to the root, the only node of the highest level.

    pos numbers the rows from 0, each once. df is read once: its block hashes, `size` rows fewer, are
    written to the shared folder, and each level is made from the one below. An empty table has no nodes.
    """
    spark = df.sparkSession
    path = working_folder(spark, "merkle")

    def level(children: DataFrame, at: str, width: int, up: int) -> DataFrame:
        held = children.groupBy(F.floor(F.col(at) / F.lit(width)).cast("long").alias("node")).agg(F.sort_array(F.collect_list(F.struct(at, "digest", "n"))).alias("_all"))  # at most `width` children
        joined = F.array_join(F.transform("_all", lambda x: x["digest"]), "")
        return held.select(F.lit(up).alias("level"), "node", F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), F.sha2(F.encode(joined, "UTF-8"), 256).alias("digest"))

    rows = df.select(F.col(pos).alias("_at"), F.sha2(F.encode(encoded(df, columns), "UTF-8"), 256).alias("digest"), F.lit(1).cast("long").alias("n"))
    level(rows, "_at", size, 0).write.parquet(f"{path}/0")
    out = held = spark.read.parquet(f"{path}/0")
    nodes, up = (held.agg(F.max("node")).first()[0] or 0) + 1, 0
    while nodes > 1:
        up, nodes = up + 1, -(-nodes // fan)
        held = level(held, "node", fan, up)
        out = out.unionByName(held)
    return out


def differing_blocks(left: DataFrame, right: DataFrame, fan: int = 64) -> DataFrame:
    """node: the blocks of level 0 whose hashes differ, or that one tree alone has; from the root down, by the children of nodes that differ.

    Trees of different height differ in all that the higher one holds beyond the lower.
    """
    spark = left.sparkSession
    a, b = (x.select("level", "node", "digest") for x in (left, right))
    top = max((x.agg(F.max("level")).first()[0] or 0) for x in (a, b))
    suspects = None
    for up in range(top, -1, -1):
        x, y = (t.where(F.col("level") == up).select("node", F.col("digest").alias(name)) for t, name in ((a, "_x"), (b, "_y")))
        if suspects is not None:
            x, y = (t.join(suspects.select(F.col("node").alias("_parent")), F.floor(F.col("node") / F.lit(fan)) == F.col("_parent"), "left_semi") for t in (x, y))
        found = x.join(y, "node", "full").where(~F.col("_x").eqNullSafe(F.col("_y"))).select("node")
        path = working_folder(spark, "merkle-differing")  # what differs at a level is known before the next is read
        found.write.parquet(path)
        suspects = spark.read.schema(found.schema).parquet(path)
    return suspects


def differing_cells(left: DataFrame, right: DataFrame, columns: Sequence[str], pos: str = "_pos", size: int = 1024, fan: int = 64) -> DataFrame:
    """pos, column_name, left_value, right_value (texts) of every cell that differs; column_name is null for a row that one table alone has.

    Rows are compared in the blocks that the two trees tell apart, and nowhere else.
    """
    blocks = differing_blocks(merkle_tree(left, columns, pos, size, fan), merkle_tree(right, columns, pos, size, fan), fan)

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(pos).alias(name), F.floor(F.col(pos) / F.lit(size)).cast("long").alias("node"), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias(f"{name}_row"))
        return rows.join(blocks, "node", "left_semi").drop("node")

    both = side(left, "_l").join(side(right, "_r"), F.col("_l") == F.col("_r"), "full")
    alone = F.col("_l").isNull() | F.col("_r").isNull()
    cell = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(f"_l_row.{c}").alias("left_value"), F.col(f"_r_row.{c}").alias("right_value"))
    odd = F.filter(F.array(*(cell(c) for c in columns)), lambda x: ~x["left_value"].eqNullSafe(x["right_value"]))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    return both.select(F.coalesce("_l", "_r").alias("pos"), F.inline(F.when(alone, whole).otherwise(odd)))


def score_digest(scores: DataFrame, ts: str = "Timestamp", score: str = "anomaly_score", most: int = 1_000_000) -> str:
    """SHA-256 of the lines `time|score` in order of time, as one text; for published score tables of at most `most` rows, larger ones have a tree."""
    n = scores.count()
    if n > most:
        raise ValueError(f"{n} rows are too many for one text; compare their merkle_tree")
    line = F.concat_ws("|", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.coalesce(seventeen_digits(F.col(score).cast("double")), F.lit("")))
    lines = scores.select(F.struct(F.col(ts).alias("t"), line.alias("line")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("all"))
    return lines.select(F.sha2(F.encode(F.concat(F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n")), "UTF-8"), 256)).first()[0]

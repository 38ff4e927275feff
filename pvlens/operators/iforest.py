"""Isolation forest: trees grown in parallel from bounded samples, scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES = "tree int, node int, feature int, threshold double, left int, right int, path double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, seed: int) -> list[tuple[int, int, float, int, int, float]]:
    """(node, feature, threshold, left, right, path) rows; feature -1 marks a leaf."""
    rng, out = np.random.Generator(np.random.PCG64(seed)), []
    limit = math.ceil(math.log2(max(2, len(x))))
    todo, made = [(0, np.arange(len(x)), 0)], 1
    while todo:
        node, at, depth = todo.pop()
        own = x[at]
        spread = own.max(0) - own.min(0) if len(at) else np.zeros(x.shape[1])
        able = np.flatnonzero(spread > 0)
        if depth >= limit or len(at) <= 1 or not len(able):
            out.append((node, -1, 0.0, -1, -1, depth + average_path(len(at))))
            continue
        f = int(rng.choice(able))
        t = float(rng.uniform(own[:, f].min(), own[:, f].max()))
        left = own[:, f] <= t
        out.append((node, f, t, made, made + 1, 0.0))
        todo += [(made, at[left], depth + 1), (made + 1, at[~left], depth + 1)]
        made += 2
    return out


def fit(df: DataFrame, features: Sequence[str], key: str, trees: int = 300, sample: int = 256, seed: int = 42) -> pd.DataFrame:
    """The forest as a table (tree, node, feature, threshold, left, right, path); at most trees * 2 * sample rows.

    One hash a row says whether it takes part at all; a row that does is dealt to as few trees as
    give each about four times its sample (one, in a large table). The smallest hashes of a
    tree are its sample.
    """
    n = df.count()
    per_row = min(trees, max(1, math.ceil(4 * sample * trees / max(1, n))))
    rate = min(1.0, 4.0 * sample * trees / max(1, n * per_row))
    unit = lambda *t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *t, F.col(key)), 11).cast("double") * F.lit(2.0**-53)
    taking = df.select(key, *features).where(unit(F.lit("part")) < rate)
    first = F.pmod(F.xxhash64(F.lit(seed), F.lit("deal"), F.col(key)), F.lit(trees))
    dealt = taking.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("_turn")).withColumn("tree", F.pmod(first + F.col("_turn") * (trees // per_row), F.lit(trees)).cast("int"))
    drawn = dealt.drop("_turn").withColumn("_u", unit(F.col("tree")))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values(["_u", key]).head(sample)
        tree = int(own["tree"].iloc[0])
        rows = grow(own[list(features)].to_numpy(float), seed * 100003 + tree)
        return pd.DataFrame([(tree, *r) for r in rows], columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    out = drawn.groupBy("tree").applyInPandas(build, TREES).toPandas().sort_values(["tree", "node"])
    out.attrs["psi"] = min(sample, n)
    return out


def score(df: DataFrame, forest: pd.DataFrame, features: Sequence[str]) -> DataFrame:
    """df with anomaly_score in (0, 1); higher is more isolated. A row with a null or NaN feature has none."""
    norm = average_path(forest.attrs["psi"]) or 1.0
    tables = [g[["feature", "threshold", "left", "right", "path"]].to_numpy() for _, g in forest.sort_values(["tree", "node"]).groupby("tree")]
    names = list(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]) if len(batch) else np.zeros((0, len(names)))
            total = np.zeros(len(x))
            for t in tables:
                at = np.zeros(len(x), np.int64)
                while (live := t[at, 0] >= 0).any():
                    row = np.flatnonzero(live)
                    f = t[at[row], 0].astype(int)
                    at[row] = np.where(x[row, f] <= t[at[row], 1], t[at[row], 2], t[at[row], 3]).astype(np.int64)
                total += t[at, 4]
            scores = 2.0 ** (-(total / max(1, len(tables))) / norm)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, mask=np.isnan(x).any(1))], [*batch.schema.names, "anomaly_score"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", anomaly_score double"
    return df.mapInArrow(run, schema)


def boxes(forest: pd.DataFrame) -> pd.DataFrame:
    """The leaves as axis-parallel boxes: tree, node, path, bounds, a list of (feature, lo, hi) for the features that the box cuts.

    A row lies in a box if lo < x <= hi for each of them; in every tree it lies in exactly one. At most
    trees * sample rows of as many bounds as a tree is deep.
    """
    out = []
    for tree, own in forest.groupby("tree"):
        nodes = {n: rest for n, *rest in own[["node", "feature", "threshold", "left", "right", "path"]].itertuples(index=False)}
        todo: list[tuple[int, dict[int, tuple[float, float]]]] = [(0, {})]
        while todo:
            node, cut = todo.pop()
            f, t, left, right, path = nodes[node]
            if f < 0:
                out.append((tree, node, path, [(k, *v) for k, v in sorted(cut.items())]))
                continue
            lo, hi = cut.get(f, (-math.inf, math.inf))
            todo += [(left, {**cut, f: (lo, min(hi, t))}), (right, {**cut, f: (max(lo, t), hi)})]
    return pd.DataFrame(out, columns=["tree", "node", "path", "bounds"])


def packed(spark: SparkSession, forest: pd.DataFrame, with_boxes: bool = False) -> DataFrame:
    """The forest as one row: an array of trees, each an array by node; its size is bounded as the forest's is, so it may be broadcast."""
    cut = {(t, n): b for t, n, _, b in boxes(forest).itertuples(index=False)} if with_boxes else {}
    trees = []
    for tree, own in forest.sort_values(["tree", "node"]).groupby("tree"):
        rows = own[["node", "feature", "threshold", "left", "right", "path"]].itertuples(index=False)
        trees.append([(int(f), float(t), int(a), int(b), float(p), cut.get((tree, n), [])) for n, f, t, a, b, p in rows])
    node = "array<array<struct<feature: int, threshold: double, left: int, right: int, path: double, bounds: array<struct<feature: int, lo: double, hi: double>>>>>"
    return spark.createDataFrame([(trees,)], f"trees {node}")


def leaf(tree: Column, x: Column, deepest: int) -> Column:
    """The leaf of a tree, an array by node, that holds the row of the values x: a comparison a level, none after the leaf."""
    step = lambda node, _: F.when(F.get(x, node["feature"]) <= node["threshold"], F.get(tree, node["left"])).otherwise(F.get(tree, node["right"]))
    return F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), F.get(tree, F.lit(0)), lambda node, i: F.when(node["feature"] < 0, node).otherwise(step(node, i)))


def score_sql(df: DataFrame, forest: pd.DataFrame, features: Sequence[str], with_boxes: bool = False) -> DataFrame:
    """What `score` gives, by expressions alone: no Python worker; with_boxes adds `inside`, the trees whose leaf, as a box, holds the row.

    Trees are added in order, as `score` does.
    """
    norm = average_path(forest.attrs["psi"]) or 1.0
    deepest = max(1, math.ceil(math.log2(max(2, forest.attrs["psi"]))))
    names = [c for c in df.columns]
    values = F.array(*(F.col(c).cast("double") for c in features))
    held = df.select(*names, values.alias("_x")).crossJoin(F.broadcast(packed(df.sparkSession, forest, with_boxes)))  # one row
    found = F.transform("trees", lambda tree: leaf(tree, F.col("_x"), deepest))
    total = F.aggregate(F.transform("trees", lambda tree: leaf(tree, F.col("_x"), deepest)["path"]), F.lit(0.0), lambda a, p: a + p)
    whole = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v))
    out = [F.when(whole, F.pow(F.lit(2.0), -(total / F.greatest(F.size("trees"), F.lit(1))) / F.lit(norm))).alias("anomaly_score")]
    if with_boxes:
        inside = lambda b: F.forall(b["bounds"], lambda k: (F.get("_x", k["feature"]) > k["lo"]) & (F.get("_x", k["feature"]) <= k["hi"]))
        out.append(F.size(F.filter(found, inside)).alias("inside"))
    return held.select(*names, *out)

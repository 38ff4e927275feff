"""Correlations of every pair of many columns in one scan: blocked Gram matrices with masks for missing cells, merged in a tree.

Each batch of rows gives, for all pairs at once, how many rows have both cells, the mean and the squared
deviations of the one where the other is there, and the co-deviations: four k x k matrices, three of
them products of the masked rows. Means are taken off before the products, and partial results are merged by
their means, so nothing cancels. A task gives one partial result; `fan_in` of them meet at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite

PARTIAL = "_part long, _moments binary"


def moments(x: np.ndarray) -> np.ndarray:
    """(count, mean, squared deviations, co-deviations) of all pairs of the columns of x; NaN is a missing cell.

    [1][i, j] and [2][i, j] are of column i over the rows where column j is there too.
    """
    here = ~np.isnan(x)
    count = here.sum(0)
    shift = np.divide(np.where(here, x, 0.0).sum(0), count, out=np.zeros(x.shape[1]), where=count > 0)
    z, m = np.where(here, x - shift, 0.0), here.astype(float)
    n, s = m.T @ m, z.T @ m
    share = np.divide(1.0, n, out=np.zeros_like(n), where=n > 0)
    mean = s * share
    return np.stack([n, np.where(n > 0, mean + shift[:, None], 0.0), (z * z).T @ m - s * mean, z.T @ z - s * s.T * share])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    both = a[0] * share
    mean = np.where(a[0] > 0, np.where(b[0] > 0, a[1] + gap * share, a[1]), b[1])
    return np.stack([n, mean, a[2] + b[2] + gap * gap * both, a[3] + b[3] + gap * gap.T * both])


def pair_moments(df: DataFrame, columns: Sequence[str], fan_in: int = 32, rows: int = 8192) -> DataFrame:
    """One row with the moments of the whole table (none for a table without partitions); one scan of df, `columns` alone."""
    k = len(columns)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = np.zeros((4, k, k)), 0
        for batch in batches:
            for a in range(0, len(batch), rows):
                piece = batch.slice(a, rows)
                own = piece.column(k)[0].as_py()
                held = merged(held, moments(np.column_stack([piece.column(i).to_numpy(zero_copy_only=False) for i in range(k)]).astype(float)))
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["_part", "_moments"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(x).reshape(4, k, k) for x in group.sort_values("_part")["_moments"]]
        while len(held) > 1:  # neighbours first
            held = [merged(*held[i : i + 2]) if i + 1 < len(held) else held[i] for i in range(0, len(held), 2)]
        return pd.DataFrame({"_part": [int(group["_part"].min()) // fan_in], "_moments": [held[0].tobytes()]})

    cells = [F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_c{i}") for i, c in enumerate(columns)]
    found = df.select(*cells, F.spark_partition_id().cast("long").alias("_part")).mapInArrow(part, PARTIAL)
    for _ in range(3):  # fan_in partial results a task
        found = found.groupBy(F.floor(F.col("_part") / F.lit(fan_in)).alias("_group")).applyInPandas(meet, PARTIAL)
    return found.groupBy(F.lit(0).alias("_group")).applyInPandas(meet, PARTIAL)  # 32,768 times fewer than tasks


def correlations(df: DataFrame, columns: Sequence[str], strong: float = 0.95, fan_in: int = 32) -> DataFrame:
    """a, b, n, r, strong for every pair of columns, over the rows where both have a finite value, the largest |r| first.

    r is null where a side is constant or no row has both. An empty table gives n = 0 for every pair.
    """
    names, k = list(columns), len(columns)

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame["_moments"]:
                n, _, m2, c = np.frombuffer(x).reshape(4, k, k)
                i, j = np.triu_indices(k, 1)
                at = np.maximum(n[i, j], 1)
                den = np.sqrt(np.maximum(m2[i, j], 0) / at) * np.sqrt(np.maximum(m2[j, i], 0) / at)
                r = [float(v) / float(d) if d > 1e-12 else None for v, d in zip(c[i, j] / at, den)]
                yield pd.DataFrame({"a": [names[p] for p in i], "b": [names[p] for p in j], "n": n[i, j].astype(np.int64), "r": pd.array(r, "Float64")})

    found = pair_moments(df, names, fan_in).mapInPandas(pairs, "a string, b string, n long, r double")
    return found.withColumn("strong", F.coalesce(F.abs("r") >= strong, F.lit(False))).orderBy(F.desc(F.abs("r")), "a", "b")

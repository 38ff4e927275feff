"""Quantiles and distinct counts of many files from states that merge without reading a file again.

A file's state is, per column, a KLL sketch of its values, an HLL sketch of their hashes, and exact counts, sums and
bounds. States are written once a file; a new file adds its own, and any set of files is answered
from the states alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The size parameter of the quantile sketch, and the error of a rank that it promises (double-sided, 99 %).
KLL_K, RANK_ERROR = 400, 0.01
#: The logarithm of the cells of the distinct sketch, and its relative error at three deviations.
HLL_LG_K, DISTINCT_ERROR = 14, 0.025


def states(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by..., column_name, n, missing, minimum, maximum, total, quantiles (KLL), distinct (HLL) of numeric columns: one pass, one row a (file, column).

    Cells are doubles; NaN counts as missing. Partial states merge before the shuffle.
    """
    cells = [F.struct(F.lit(c).alias("column_name"), F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias("value")) for c in columns]
    long = df.select(*by, F.inline(F.array(*cells)))
    return long.groupBy(*by, "column_name").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.sum("value").alias("total"),
        F.kll_sketch_agg_double("value", F.lit(KLL_K)).alias("quantiles"), F.hll_sketch_agg(F.xxhash64("value"), F.lit(HLL_LG_K)).alias("distinct"),
    )


def merged(held: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The states of groups of files (all of them without `by`), of the same shape: states merge like the values they stand for."""
    return held.groupBy(*by, "column_name").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.sum("total").alias("total"),
        F.kll_merge_agg_double("quantiles", F.lit(KLL_K)).alias("quantiles"), F.hll_union_agg("distinct", F.lit(False)).alias("distinct"),
    )


def answers(held: DataFrame, shares: dict[str, float]) -> DataFrame:
    """column_name (and by...), n, missing, minimum, maximum, mean, distinct and one column a share, from states.

    A quantile's rank is within `RANK_ERROR` of its share, the number of distinct values within `DISTINCT_ERROR`; where no
    value is there they are null and 0.
    """
    kept = [c for c in held.columns if c not in ("total", "quantiles", "distinct")]
    quantile = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))))
    number = F.when(F.col("n") > 0, F.hll_sketch_estimate("distinct")).otherwise(F.lit(0).cast("long"))
    return held.select(*kept, F.try_divide("total", "n").alias("mean"), number.alias("distinct"), *(quantile(p).alias(name) for name, p in shares.items()))

"""Window helpers: full trailing windows, islands, neighbours. All take a partition key."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ordered(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def full(agg: Column, value: Column, n: int, w: WindowSpec) -> Column:
    """agg over the last n rows, null unless all n hold a value."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, agg.over(frame))


def trailing(df: DataFrame, wanted: Sequence[tuple[str, str, str, int]], w: WindowSpec) -> DataFrame:
    """df with wanted (name, column, statistic, rows): mean, std (population), min or max of the last rows, null unless all hold a value.

    Each width must be a multiple of the one below it. Sums are added up row by row, oldest first, so that their last digits do not
    depend on the other widths; all else of a wider frame is joined from the narrower ones that end some rows earlier, deviations
    from their sums of squares about their own means.
    """
    widths = sorted({n for *_, n in wanted})
    if any(b % a for a, b in zip(widths, widths[1:])):
        raise ValueError(f"each width must be a multiple of the one below it: {widths}")
    stats = {c: {s for _, x, s, _ in wanted if x == c} for c in dict.fromkeys(c for _, c, *_ in wanted)}
    at = lambda kind, c, n: f"_{kind}_{n}_{c}"
    own, rows = df.columns, df
    for below, n in zip([None, *widths], widths):
        totals, parts = [], []
        for c, found in stats.items():
            if below is None:
                parts.append(full(F.sum(c), F.col(c), n, w).alias(at("sum", c, n)))
                if "std" in found:
                    parts.append((full(F.var_pop(c), F.col(c), n, w) * n).alias(at("square", c, n)))
                parts += [full(f(c), F.col(c), n, w).alias(at(s, c, n)) for s, f in (("min", F.min), ("max", F.max)) if s in found]
                continue
            past = lambda kind, c=c: [F.lag(at(kind, c, below), k).over(w) if k else F.col(at(kind, c, below)) for k in range(n - below, -1, -below)]  # noqa: E731, B023
            sums, total = past("sum"), F.col(at("sum", c, n))
            whole = functools.reduce(operator.and_, (x.isNotNull() for x in sums))
            totals.append(F.when(whole, F.sum(c).over(w.rowsBetween(-(n - 1), 0))).alias(at("sum", c, n)))
            if "std" in found:
                squares, means = past("square"), [x / below for x in sums]
                apart = [(x - y) * (x - y) for i, x in enumerate(means) for y in means[:i]]  # exactly 0 where all rows are equal
                parts.append((sum(squares[1:], squares[0]) + sum(apart[1:], apart[0]) * (below * below / n)).alias(at("square", c, n)))
            parts += [F.when(total.isNotNull(), f(*past(s))).alias(at(s, c, n)) for s, f in (("min", F.least), ("max", F.greatest)) if s in found]
        rows = rows.select("*", *totals)
        rows = rows.select("*", *parts)
    cell = {"mean": lambda c, n: F.col(at("sum", c, n)) / n, "std": lambda c, n: F.sqrt(F.col(at("square", c, n)) / n)}
    return rows.select(*own, *((cell[s](c, n) if s in cell else F.col(at(s, c, n))).alias(name) for name, c, s, n in wanted))


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a naive timestamp, on its own clock: never an instant of the session's zone."""
    since = c.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def naive(us: Column) -> Column:
    """The naive timestamp of `micros`."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), us.cast("decimal(18,0)") / 1_000_000)


def seconds_between(a: Column, b: Column) -> Column:
    return (micros(a) - micros(b)) / F.lit(1_000_000)


def islands(df: DataFrame, starts: Column, w: WindowSpec, name: str = "island") -> DataFrame:
    """Number runs within each partition; `starts` is true on the first row of a run."""
    return df.withColumn("_s", F.when(starts, 1).otherwise(0)).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def changed(c: Column, w: WindowSpec) -> Column:
    """True on the first row and where the value differs from the row before."""
    return (F.row_number().over(w) == 1) | ~c.eqNullSafe(F.lag(c).over(w))

"""The largest steps of signals with what went before them, column statistics with a verdict, and files at a glance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import in_chunks, percentiles, with_group
from ..functions.scalars import blank_to_null, corr, finite, parse_number
from .review import long_form


def _with_previous(df: DataFrame, carried: Sequence[str], by: Sequence[str], place: str) -> DataFrame:
    """df with _before, the carried cells of the row before; a long series is cut into chunks of places."""

    def step(rows: DataFrame, part: list[str]) -> DataFrame:
        return rows.withColumn("_before", F.lag(F.struct(*carried)).over(Window.partitionBy(*part).orderBy(place)))

    return in_chunks(df.select(*by, place, *carried), 1, 0, step, by, place)


def largest_transitions(df: DataFrame, signals: Sequence[str], k: int = 10, by: Sequence[str] = ("series",), place: str = "n", ts: str = "Timestamp", context: str = "low_light_context") -> DataFrame:
    """signal, rank, by..., place, ts, previous_ts, previous_value, value, change, other_changes, previous_context, context, context_changed.

    The k largest absolute steps of each signal from one row of a series to the next, ties to the smaller series and
    place. `place` counts the rows of a series from 0. other_changes: the steps of the other signals at the same row, by name. Steps
    from or to a cell that is missing, NaN or infinite are none. A table without steps gives no rows.
    """
    carried = list(dict.fromkeys([ts, context, *signals]))
    change = {s: F.col(s).cast("double") - F.col("_before")[s].cast("double") for s in signals}
    steps = F.array(*(
        F.struct(
            F.lit(s).alias("signal"), F.col("_before")[s].cast("double").alias("previous_value"), F.col(s).cast("double").alias("value"), change[s].alias("change"),
            F.map_from_arrays(F.array(*(F.lit(o) for o in signals if o != s)).cast("array<string>"), F.array(*(change[o] for o in signals if o != s)).cast("array<double>")).alias("other_changes"),
        )
        for s in signals
    ))
    moved = ~F.col("_before")[context].eqNullSafe(F.col(context))
    facts = [F.col("_before")[ts].alias("previous_ts"), F.col("_before")[context].alias("previous_context"), F.col(context).alias("context"), moved.alias("context_changed")]
    rows = _with_previous(df, carried, by, place).select(*by, place, ts, *facts, F.inline(steps)).where(finite(F.col("change")))
    # Only the first k rows of each task and signal are shuffled.
    first = Window.partitionBy("signal").orderBy(F.abs("change").desc(), *by, place)
    ranked = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select("signal", "rank", *by, place, ts, "previous_ts", "previous_value", "value", "change", "other_changes", "previous_context", "context", "context_changed")


def shared_transitions(top: DataFrame, first: str, second: str, on: Sequence[str] = ("series", "n", "Timestamp")) -> DataFrame:
    """on..., first_rank, second_rank: the rows that are among the largest steps of both signals; `top` as from `largest_transitions`."""
    side = lambda s, name: top.where(F.col("signal") == s).select(*on, F.col("rank").alias(name))
    return side(first, "first_rank").join(side(second, "second_rank"), list(on))


def transition_summary(top: DataFrame) -> DataFrame:
    """signal, n, in_low_light, context_changes, largest, smallest: of the largest steps of each signal."""
    size = F.abs("change")
    return top.groupBy("signal").agg(F.count("*").alias("n"), F.count_if(F.col("context") == 1).alias("in_low_light"), F.count_if("context_changed").alias("context_changes"), F.max(size).alias("largest"), F.min(size).alias("smallest"))


def step_correlation(df: DataFrame, first: str, second: str, by: Sequence[str] = ("series",), place: str = "n") -> DataFrame:
    """One row n, r: correlation of the steps that both signals make at the same row; null for fewer than two or without spread."""
    steps = _with_previous(df, [first, second], by, place).select(*((F.col(s) - F.col("_before")[s]).cast("double").alias(a) for s, a in ((first, "x"), (second, "y"))))
    return steps.where(finite(F.col("x")) & finite(F.col("y"))).agg(F.count("*").alias("n"), corr(F.col("x"), F.col("y")).alias("r"))


def column_statistics(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by..., column_name, n, nan_count, infinite_count, finite_count, minimum, maximum, mean, median, std, std_pop, var_pop, usable.

    NaN counts as missing. std has ddof 1. usable: no cell missing or infinite, and the (population) variance is
    positive. A column without values has nulls for its statistics; an empty table gives no rows.
    """
    long = long_form(df, columns, *by).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    v, key = F.col("value"), [*by, "column_name"]
    facts = long.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("nan_count"), F.count_if(v.isNotNull() & ~finite(v)).alias("infinite_count"), F.count_if(finite(v)).alias("finite_count"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"), F.var_pop(v).alias("var_pop"),
    )
    spread = F.coalesce(finite(F.col("var_pop")) & (F.col("var_pop") > 0), F.lit(False))
    out = with_group(facts, percentiles(long, "value", {"median": 0.5}, key), key, "left").withColumn("usable", (F.col("finite_count") == F.col("n")) & spread)
    return out.select(*key, "n", "nan_count", "infinite_count", "finite_count", "minimum", "maximum", "mean", "median", "std", "std_pop", "var_pop", "usable")


def window_contract(near: DataFrame, minutes: float = 20, cadence: float = 2, by: Sequence[str] = ()) -> DataFrame:
    """by..., moment, n, off_grid, complete: whether each moment has just one row at every step of the window; `near` as from `near_events`."""
    want, at = int(2 * minutes / cadence) + 1, F.col("offset_minutes")
    got = near.groupBy(*by, "moment").agg(F.count("*").alias("n"), F.count_if(at % cadence != 0).alias("off_grid"), F.count_distinct(at).alias("_steps"))
    return got.withColumn("complete", (F.col("n") == want) & (F.col("_steps") == want) & (F.col("off_grid") == 0)).drop("_steps")


def inspect_files(rows: DataFrame, columns: Sequence[str] | None = None, most_values: int = 10) -> DataFrame:
    """file, place, column_name, kind, n, missing, distinct, lowest, highest, values, duplicate_rows: one row a file and column.

    rows: text as from `read_text_columns`. Blank cells are missing; distinct counts missing as one value. kind: number where every
    other cell reads as one, empty without any, else text; lowest and highest are those of numbers. values: in order, where there
    are at most `most_values`, else null. duplicate_rows: rows of the file that repeat another of it in all columns.
    """
    columns = list(columns or [c for c in rows.columns if c not in ("_file", "_pos")])
    cells = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("column_name"), blank_to_null(F.col(c)).alias("value")) for i, c in enumerate(columns)]
    key = ["file", "place", "column_name"]
    counts = rows.select(F.col("_file").alias("file"), F.inline(F.array(*cells))).groupBy(*key, "value").agg(F.count("*").alias("k"))
    read, given = parse_number(F.col("value")), F.col("value").isNotNull()
    facts = counts.groupBy(*key).agg(
        F.sum("k").alias("n"), F.coalesce(F.sum(F.when(~given, F.col("k"))), F.lit(0)).alias("missing"), F.count("*").alias("distinct"), F.count_if(given).alias("_given"), F.count_if(given & read.isNotNull()).alias("_read"),
        F.min(read).alias("_low"), F.max(read).alias("_high"),
    )
    kind = F.when(F.col("_given") == 0, "empty").when(F.col("_given") == F.col("_read"), "number").otherwise("text")
    few = counts.where("value is not null").withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy("value"))).where(F.col("_at") <= most_values)
    lists = few.groupBy(*key).agg(F.sort_array(F.collect_list("value")).alias("_values"))  # at most `most_values`
    again = rows.groupBy(F.col("_file").alias("file"), *(F.col(c) for c in columns)).agg(F.count("*").alias("_k")).groupBy("file").agg(F.sum(F.col("_k") - 1).alias("duplicate_rows"))
    out = with_group(with_group(facts.withColumn("kind", kind), lists, key, "left"), again, ["file"])
    number = F.col("kind") == "number"
    values = F.when(F.col("_given") <= most_values, F.coalesce("_values", F.array().cast("array<string>")))
    return out.select(*key, "kind", "n", "missing", "distinct", F.when(number, F.col("_low")).alias("lowest"), F.when(number, F.col("_high")).alias("highest"), values.alias("values"), "duplicate_rows")

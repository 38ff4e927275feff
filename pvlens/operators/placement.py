"""Synthetic events on many series at once: the starts are counted, drawn and resolved by rank in plans over all series.

The rows are read once for their rooms. Then every scenario is one job for all series: starts are counted by
(series, chunk, length), a draw picks a length and a rank in each series, and the rank is found through
the counts of the chunks before, so that only one chunk of a series is numbered. What passes
through Python is one row a series: the state of its generator and its counts.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import with_group
from ..functions.scalars import different
from ..sources.folders import working_folder
from .synthetic import EFFECTS, Scenario, effected, rooms

EVENT = "struct<event_id: string, scenario: string, start: bigint, n_rows: int, severity: double, columns: array<string>>"
SKIP = "struct<scenario: string, reason: string, severity: double>"
SPAN = "struct<start: bigint, end: bigint>"


def seed_of(by: Sequence[str]) -> Column:
    """The second word of a series' seed: `place` with seed [seed, this] makes the same draws for the series alone."""
    return F.crc32(F.to_json(F.struct(*by)).cast("binary"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back: its lineage ends here."""
    path = working_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _beside(room: Column, pos: Column, taken: Column, gap: int) -> Column:
    """`synthetic.room_beside` where the ranges taken are an array of the row (one entry an event, at most one a scenario)."""
    cut = lambda left, x: F.when(pos >= x["end"] + gap, left).otherwise(F.least(left, F.greatest(F.lit(0).cast("long"), x["start"] - gap - pos)))
    return F.aggregate(taken, room.cast("long"), cut)


def _drawer(s: Scenario, reserved: int, seed: int):
    """One row a series to its draw; `starts` holds, for every length, how many rows an event of it may start at."""
    lo, hi = s.rows

    @F.pandas_udf("rng string, severity double, columns array<string>, n int, at long, reason string")
    def draw(state: pd.Series, word: pd.Series, left: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for state_, word_, left_, starts_ in zip(state, word, left, starts):
            bits = np.random.PCG64([seed, int(word_)])
            if state_ is not None:
                bits.state = json.loads(state_)
            rng = np.random.Generator(bits)
            severity, columns = s.draw(rng)
            spare = left_ - reserved
            most = min(hi, spare if spare >= lo else left_)
            n = at = reason = None
            if most < lo:
                reason = "budget"
            elif starts_ is None or not (able := [i for i in range(most - lo + 1) if starts_[i]]):
                reason = "no_place"
            else:
                i = able[int(rng.integers(0, len(able)))]
                n, at = lo + i, int(rng.integers(0, int(starts_[i])))
            out.append((json.dumps(bits.state), severity, list(columns), n, at, reason))
        found = pd.DataFrame(out, columns=["rng", "severity", "columns", "n", "at", "reason"])
        return found.astype({"n": "Int32", "at": "Int64"})

    return draw


def _placed(df: DataFrame, table: DataFrame, state: DataFrame, s: Scenario, reserved: int, seed: int, gap: int, by: list[str], pos: str, chunk: int) -> DataFrame:
    """The state of every series after scenario s."""
    lo, hi = s.rows
    open_rows = table.select(*by, F.col(pos).alias("_at"), F.col(f"rooms.{s.name}").alias("_room")).where(F.col("_room") >= lo)
    own = with_group(open_rows, state.select(*by, "_taken"), by).withColumn("_room", _beside(F.col("_room"), F.col("_at"), F.col("_taken"), gap)).where(F.col("_room") >= lo)
    own = own.select(*by, "_at", "_room", F.floor(F.col("_at") / F.lit(chunk)).alias("_chunk"))
    fits = F.array(*(F.count_if(F.col("_room") >= n) for n in range(lo, hi + 1)))
    blocks = own.groupBy(*by, "_chunk").agg(fits.alias("_fits"))
    starts = blocks.groupBy(*by).agg(F.array(*(F.sum(F.col("_fits")[i]) for i in range(hi - lo + 1))).alias("_starts"))
    drawn = with_group(state, starts, by, "left").withColumn("_draw", _drawer(s, reserved, seed)("_rng", "_word", "_left", "_starts")).drop("_starts")

    wanted = drawn.where("_draw.n is not null").select(*by, F.col("_draw.n").alias("_n"), F.col("_draw.at").alias("_rank"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    counted = with_group(blocks, wanted, by).withColumn("_here", F.element_at("_fits", F.col("_n") - lo + 1))
    counted = counted.withColumn("_rank", F.col("_rank") - F.coalesce(F.sum("_here").over(before), F.lit(0)))
    held = counted.where((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_here"))).select(*by, "_chunk", "_n", "_rank")
    inside = with_group(own, held, [*by, "_chunk"]).where(F.col("_room") >= F.col("_n"))
    numbered = inside.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy("_at")) - 1)
    found = with_group(drawn, numbered.where("_k = _rank").select(*by, F.col("_at").alias("_start")), by, "left")

    spans = found.where("_start is not null").select(*by, "_start", F.col("_draw.n").alias("_rows"), F.col("_draw.severity").alias("_severity"), F.col("_draw.columns").alias("_columns"))
    cells = df.select(*by, F.col(pos).alias("_at"), *(F.col(c).alias(f"_cell_{c}") for c in s.columns))
    touched = with_group(cells, spans, by).where(F.col("_at").between(F.col("_start"), F.col("_start") + F.col("_rows") - 1))
    passed, moved = (F.col("_at") - F.col("_start") + 1) / F.col("_rows"), F.lit(False)
    for c in s.columns:
        cell = F.col(f"_cell_{c}")
        moved = moved | (F.array_contains("_columns", c) & different(cell, EFFECTS[s.effect](cell, F.col("_severity"), passed)))
    trial = touched.groupBy(*by).agg(F.bool_or(~moved).alias("_still"))
    found = with_group(found, trial, by, "left")

    name, draw = F.lit(s.name), F.col("_draw")
    takes = F.col("_start").isNotNull() & ~F.coalesce("_still", F.lit(False))
    event = F.struct(F.format_string("event-%02d", F.size("_events") + 1).alias("event_id"), name.alias("scenario"), F.col("_start").alias("start"), draw["n"].alias("n_rows"), draw["severity"].alias("severity"), draw["columns"].alias("columns"))
    span = F.struct(F.col("_start").alias("start"), (F.col("_start") + draw["n"]).alias("end"))
    skip = F.struct(name.alias("scenario"), F.coalesce(draw["reason"], F.lit("no_effect")).alias("reason"), draw["severity"].alias("severity"))
    more = lambda column, x, kind, when: F.when(when, F.concat(column, F.array(x.cast(kind)))).otherwise(F.col(column)).alias(column)
    return found.select(
        *by, "_word", draw["rng"].alias("_rng"), F.when(takes, F.col("_left") - draw["n"]).otherwise(F.col("_left")).alias("_left"),
        more("_taken", span, SPAN, takes), more("_events", event, EVENT, takes), more("_skipped", skip, SKIP, ~takes),
    )


def place_all(df: DataFrame, scenarios: Sequence[Scenario], ok: dict[str, Column], forbidden: Column, seed: int, by: Sequence[str], share: float = 0.05, gap_rows: int = 30, pos: str = "_pos", chunk: int = 1 << 16, **options) -> tuple[DataFrame, DataFrame]:
    """(events, skipped) of every series: by..., then the fields of `synthetic.place`, whose result for one series it equals.

    A series is seeded by [seed, seed_of(by)], so that it draws on its own and alike in any company. One job finds the
    rooms, one begins the state, then one a scenario, however many series there are; a null key is a series like others.
    """
    by = list(by)
    if not by:
        raise ValueError("name the columns of a series; `synthetic.place` is for a single one")
    queue = sorted(scenarios, key=lambda s: -s.rows[0])  # stable: equals as declared
    table = _written(rooms(df, {s.name: s.rows[1] for s in scenarios}, ok, forbidden, pos=pos, by=by, **options).select(*by, pos, "rooms"), "rooms")
    none = lambda kind, name: F.expr(f"cast(array() as array<{kind}>)").alias(name)
    budget = F.floor(F.count("*") * F.lit(share)).alias("_left")
    state = table.groupBy(*by).agg(budget).select(*by, seed_of(by).alias("_word"), F.lit(None).cast("string").alias("_rng"), "_left", none(SPAN, "_taken"), none(EVENT, "_events"), none(SKIP, "_skipped"))
    state = _written(state, "placement")
    for i, s in enumerate(queue):
        reserved = sum(x.rows[0] for x in queue[i + 1 :])
        state = _written(_placed(df, table, state, s, reserved, seed, gap_rows, by, pos, chunk), "placement")
    return state.select(*by, F.inline("_events")), state.select(*by, F.inline("_skipped"))


def inject_all(df: DataFrame, events: DataFrame, scenarios: Sequence[Scenario], by: Sequence[str], pos: str = "_pos") -> DataFrame:
    """`synthetic.inject` with the events of many series, joined on the series; ids count from 1 in each."""
    names = {"event_id": "_event", "scenario": "_scenario", "start": "_start", "n_rows": "_rows", "severity": "_severity", "columns": "_columns"}
    at = events.select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), *(F.col(c).alias(x) for c, x in names.items()))
    inside = F.col(pos).between(F.col("_start"), F.col("_start") + F.col("_rows") - 1)
    for i, c in enumerate(by):
        inside = inside & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    return effected(df.join(at, inside, "left"), scenarios, pos).drop(*(f"_by_{i}" for i in range(len(by))))

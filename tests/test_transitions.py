import math
import random
import statistics
from datetime import datetime, timedelta

import pytest

from pvlens.operators import review, transitions
from pvlens.sources import operational

START = datetime(2022, 3, 13, 1, 0)
STEP_SCHEMA = "series long, n long, Timestamp timestamp_ntz, a double, b double, low_light_context int"


def at(n):
    return START + timedelta(minutes=2 * n)


def steps(rows, signal, k):
    """By definition: rows in order, the largest absolute steps first, ties to the smaller series and place."""
    i = {"a": 3, "b": 4}[signal]
    found = [(abs(y[i] - x[i]), y[0], y[1], y[i] - x[i]) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and None not in (x[i], y[i]) and math.isfinite(y[i] - x[i])]
    return [x[1:] for x in sorted(found, key=lambda x: (-x[0], x[1], x[2]))[:k]]


@pytest.fixture(scope="module")
def walk():
    rng = random.Random(5)
    cell = lambda: rng.choice([None, math.inf, math.nan, *range(9)]) if rng.random() < 0.3 else float(rng.randrange(40))
    return [(s, n, at(n), *(None if x is None else float(x) for x in (cell(), cell())), rng.randrange(2)) for s in range(4) for n in range(60)]


def test_largest_steps_are_those_by_definition(spark, walk):
    top = transitions.largest_transitions(spark.createDataFrame(walk, STEP_SCHEMA), ["a", "b"], k=12).collect()
    own = {(r[0], r[1]): r for r in walk}
    for signal in ("a", "b"):
        got = sorted((r for r in top if r.signal == signal), key=lambda r: r["rank"])
        assert [(r.series, r.n, r.change) for r in got] == steps(walk, signal, 12)
        for r in got:
            before = own[r.series, r.n - 1]
            assert (r.previous_ts, r.previous_context, r.context_changed) == (before[2], before[5], before[5] != r.context)
            assert set(r.other_changes) == {"ab".replace(signal, "")}


def test_steps_across_chunks(spark, walk, monkeypatch):
    from pvlens.functions import ordering

    plain = transitions.largest_transitions(spark.createDataFrame(walk, STEP_SCHEMA), ["a"], k=12).collect()
    monkeypatch.setattr(transitions, "in_chunks", lambda df, back, ahead, step, by, place: ordering.in_chunks(df, back, ahead, step, by, place, size=7))
    assert transitions.largest_transitions(spark.createDataFrame(walk, STEP_SCHEMA), ["a"], k=12).drop("other_changes").collect() == [r[:9] + r[10:] for r in plain]


def test_shared_and_summed(spark):
    rows = [(1, n, at(n), float(a), float(b), n % 2) for n, (a, b) in enumerate([(0, 0), (9, 1), (9, 8), (1, 0)])]
    df = spark.createDataFrame(rows, STEP_SCHEMA)
    top = transitions.largest_transitions(df, ["a", "b"], k=2).persist()
    assert [tuple(r) for r in transitions.shared_transitions(top, "a", "b").collect()] == [(1, 3, at(3), 2, 1)]
    assert {tuple(r) for r in transitions.transition_summary(top).collect()} == {("a", 2, 2, 2, 9.0, 8.0), ("b", 2, 1, 2, 8.0, 7.0)}
    r = transitions.step_correlation(df, "a", "b").first()
    assert r.n == 3 and math.isclose(r.r, statistics.correlation([9, 0, -8], [1, 7, -8]))


def test_no_steps(spark):
    one = spark.createDataFrame([(1, 0, at(0), 1.0, None, 0)], STEP_SCHEMA)
    for df in (one, one.limit(0)):
        assert transitions.largest_transitions(df, ["a", "b"]).count() == 0
        assert tuple(transitions.step_correlation(df, "a", "b").first()) == (0, None)


def test_statistics_and_usable(spark):
    rows = [("p", 1.0, 3.0, math.nan, None), ("p", 2.0, 3.0, 1.0, None), ("p", 4.0, 3.0, math.inf, None), ("q", 5.0, 1.0, 2.0, 1.0), ("q", 7.0, 2.0, 4.0, 3.0)]
    df = spark.createDataFrame(rows, "part string, good double, flat double, gaps double, none double")
    got = {(r.part, r.column_name): r for r in transitions.column_statistics(df, ["good", "flat", "gaps", "none"], ["part"]).collect()}
    assert {k for k, r in got.items() if r.usable} == {("p", "good"), ("q", "good"), ("q", "flat"), ("q", "gaps"), ("q", "none")}
    r = got["p", "good"]
    assert (r.n, r.nan_count, r.minimum, r.maximum, r.median) == (3, 0, 1.0, 4.0, 2.0)
    assert math.isclose(r["std"], statistics.stdev([1, 2, 4])) and math.isclose(r.var_pop, statistics.pvariance([1, 2, 4]))
    assert (got["p", "gaps"].nan_count, got["p", "gaps"].infinite_count, got["p", "gaps"].finite_count) == (1, 1, 1)
    r = got["p", "none"]
    assert (r.nan_count, r.finite_count, r["mean"], r.median, r.minimum) == (3, 0, None, None, None)
    assert transitions.column_statistics(df.limit(0), ["good"]).count() == 0


def test_window_contract(spark):
    whole = [(1, at(n)) for n in range(50)]
    rows = whole + [(2, t) for _, t in whole if t != at(12)] + [(3, t) for _, t in whole] + [(3, at(12))] + [(4, t if t != at(12) else t + timedelta(minutes=1)) for _, t in whole]
    near = review.near_events(spark.createDataFrame(rows, "series long, Timestamp timestamp_ntz"), [at(15)])
    got = {r.series: (r.n, r.off_grid, r.complete) for r in transitions.window_contract(near, by=["series"]).collect()}
    assert got == {1: (21, 0, True), 2: (20, 0, False), 3: (22, 0, False), 4: (21, 1, False)}
    with pytest.raises(ValueError, match="too many"):
        review.near_events(near, range(10_001))


def test_rows_between_two_events_are_no_neighbours(spark):
    # Events at places 10 and 60 of 100; the rows far from both hold 1000, the neighbours 1.
    hit = {10, 60}
    rows = [(1, at(n), 5.0 if n in hit else 1.0 if min(abs(n - x) for x in hit) <= 5 else 1000.0, n in hit) for n in range(100)]
    df = spark.createDataFrame(rows, "series long, Timestamp timestamp_ntz, x double, event boolean").union(spark.createDataFrame([(2, at(0), 1.0, None)], "series long, Timestamp timestamp_ntz, x double, event boolean"))
    got = review.spike_review(df, "x", df["event"]).collect()
    assert [tuple(r) for r in got] == [(1, 5.0, 1000.0, 1.0, False)]


def test_inspect_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,x,y\n1,2,\n1,2,\n3, ,\n")
    (tmp_path / "b.csv").write_text("t,x,y\none,5,\n" + "".join(f"{i},6,u{i}\n" for i in range(12)))
    raw = operational.read_text_columns(spark, str(tmp_path))
    got = {(r.file.rsplit("/", 1)[1], r.column_name): r for r in transitions.inspect_files(raw).collect()}
    pick = lambda r: (r.kind, r.n, r.missing, r.distinct, r.lowest, r.highest, r["values"], r.duplicate_rows)
    assert pick(got["a.csv", "t"]) == ("number", 3, 0, 2, 1.0, 3.0, ["1", "3"], 1)
    assert pick(got["a.csv", "x"]) == ("number", 3, 1, 2, 2.0, 2.0, ["2"], 1)
    assert pick(got["a.csv", "y"]) == ("empty", 3, 3, 1, None, None, [], 1)
    assert pick(got["b.csv", "t"])[:4] == ("text", 13, 0, 13) and got["b.csv", "t"]["values"] is None
    assert pick(got["b.csv", "y"])[:4] == ("text", 13, 1, 13) and got["b.csv", "y"].duplicate_rows == 0
    assert transitions.inspect_files(raw.limit(0)).count() == 0

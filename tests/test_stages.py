"""Stages end to end on a small series, the frozen detector, pinned scans and sinks, configurations, detection helpers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvlens import schema as S
from pvlens.functions.ordering import in_chunks, numbered_runs, percentiles, positions, with_ranks
from pvlens.operators import features, iforest, review, serving, synthetic, vision
from pvlens.plans import stages
from pvlens.sources import configs, operational, reports

START = dt.datetime(2022, 5, 1)


@pytest.fixture(scope="module")
def plant(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        v, a = 30 + rng.random(), 2 + np.sin(i / 40) + rng.random() / 10
        rows.append(("a", i, START + dt.timedelta(minutes=2 * i), 20 + rng.random(), 40 + rng.random(), rng.random(), 90.0 + rng.random(), 300 * np.sin(i / 40) + rng.random(), *(25 + rng.random(5)), v, a, v * a))
    schema = "series string, n long, Timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in S.MEASUREMENTS)
    return spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows], schema).persist()


@pytest.fixture(scope="module")
def table81(plant):
    return stages.engineer(plant, "series", "n")["table"].persist()


BOUNDS = [("training", 0, 119), ("calibration", 120, 179), ("evaluation", 180, 239)]


def test_one_series_in_chunks_is_the_same(plant, table81, monkeypatch):
    small = lambda df, back, ahead, step, by=(), pos="_pos", size=0: in_chunks(df, back, ahead, step, by, pos, 17)
    monkeypatch.setattr(features, "in_chunks", small)
    one = features.features(plant.select(*S.S14)).orderBy("Timestamp").collect()
    many = table81.select(*S.S81).orderBy("Timestamp").collect()
    for a, b in zip(one, many, strict=True):
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:]))


def test_ordering_helpers(spark):
    rng = np.random.default_rng(4)
    x = [None if i % 11 == 0 else float(v) for i, v in enumerate(rng.integers(0, 40, 500))]
    df = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(x)], "id long, g long, x double")
    got = {r.g: (r.a, r.b) for r in percentiles(df, "x", {"a": 0.5, "b": 0.975}, ["g"]).collect()}
    for g in range(3):
        own = [v for i, v in enumerate(x) if i % 3 == g and v is not None]
        assert np.allclose(got[g], np.percentile(own, [50, 97.5]))
    for r in with_ranks(df, "x", ["g"]).collect():
        own = [v for i, v in enumerate(x) if i % 3 == r.g and v is not None]
        if r.x is not None:
            below, equal = sum(v < r.x for v in own), sum(v == r.x for v in own)
            assert r.rank_asc == below + (equal + 1) / 2 and r.rank_desc == sum(v > r.x for v in own) + 1
    order = sorted(range(500), key=lambda i: (x[i] is not None, x[i] or 0, i))
    place = {r.id: r._pos for r in positions(df, "x", ["id"], blocks=7).collect()}
    assert [place[i] for i in order] == list(range(500))
    runs = numbered_runs(positions(df.select("id"), "id"), lambda previous: F.col("id") % 50 == 0, size=16)
    assert {r.id: r._run for r in runs.collect()} == {i: i // 50 + 1 for i in range(500)}


def test_train_save_load_serve(spark, table81, tmp_path):
    parts = stages.split(table81, BOUNDS, "n")["table"]
    found, scored = stages.train(parts, review.NO_TIME, "n", ("Timestamp", "series"), trees=20, sample=64, threshold=0.55)
    assert scored.count() == 240 and scored.where("anomaly_score <= 0 or anomaly_score >= 1").isEmpty()
    folder = f"file://{tmp_path}/frozen"
    serving.save_detector(spark, found, folder)
    again = serving.load_detector(spark, folder)
    assert again.hashes() == found.hashes()
    a, b = (serving.score_frame(parts, x, ["n"]).orderBy("n").collect() for x in (found, again))
    assert a == b
    row = parts.where("n = 200").first().asDict()
    assert serving.score_observation(spark, row, again)["anomaly_score"] == next(r.anomaly_score for r in a if r.n == 200)
    empty = serving.score_frame(parts.where("n < 0"), again, ["n"])
    assert empty.count() == 0 and empty.columns == ["n", "anomaly_score", "threshold", "threshold_margin", "status"]
    with pytest.raises(ValueError, match="not_finite_Air_Temp"):
        serving.score_frame(parts.withColumn("Air_Temp", F.when(F.col("n") != 5, F.col("Air_Temp"))), again)
    with pytest.raises(ValueError, match="missing columns"):
        serving.score_frame(parts.drop("rtd_std"), again)
    spark.read.parquet(f"{folder}/forest").withColumn("path", F.col("path") + 0.5).coalesce(1).write.parquet(f"{folder}2/forest")
    for part in ("scaler",):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{folder}2/{part}")
    spark.read.text(f"{folder}/manifest").coalesce(1).write.text(f"{folder}2/manifest")
    with pytest.raises(ValueError, match="forest"):
        serving.load_detector(spark, f"{folder}2")
    feed = stages.export_feed(parts, again, f"file://{tmp_path}/feed", ["series"])
    assert feed.count() == 240 and serving.dashboard_summary(feed, by=("series",)).first().rows == 240
    report = stages.investigate(scored.withColumn("context", F.lit(0)), "context")
    assert report["statistics"].count() == 3 and report["top"].count() == 30
    chosen = stages.calibrate(scored, [("p90", "percentile", 90.0), ("p95", "percentile", 95.0)], (1, 30), (1, 20), 1.0, 1.0, 5.0, ("series",), odd=F.lit(False))
    assert chosen["choice"].first().rule == "p95" and chosen["evaluation"].count() == 1


def test_forest_against_a_plain_walk(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    x[7] = 9.0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    forest = iforest.fit(df, ["a", "b", "c"], "id", trees=30, sample=32)
    assert forest.groupby("tree").ngroups == 30
    got = {r.id: r.anomaly_score for r in iforest.score(df, forest, ["a", "b", "c"]).collect()}
    nodes = {(r.tree, r.node): r for r in forest.itertuples()}

    def path(row, tree):
        at = nodes[tree, 0]
        while at.feature >= 0:
            at = nodes[tree, at.left if row[at.feature] <= at.threshold else at.right]
        return at.path

    for i in range(0, 400, 37):
        want = 2 ** (-np.mean([path(x[i], t) for t in range(30)]) / iforest.average_path(32))
        assert abs(got[i] - want) < 1e-12
    assert max(got, key=got.get) == 7


def test_generate_and_evaluate(plant, table81):
    plan = [synthetic.Scenario("drop", ("Power_Generated", "Array_Voltage"), (3, 5), (0.2, 0.4), "lower"), synthetic.Scenario("sensor", ("Air_Temp", "Relative_Humidity"), (2, 2), {"Air_Temp": (5.0, 9.0), "Relative_Humidity": (20.0, 30.0)}, "offset")]
    made = stages.generate(plant, plan, {s.name: F.col("Solar_Radiation") > 5 for s in plan}, F.lit(False), 11, "series", pos="n")
    assert len(made["events"]) == 2 and not made["skipped"]
    found, _ = stages.train(stages.split(table81, BOUNDS, "n")["table"], review.NO_TIME, "n", trees=20, sample=64, threshold=0.5)
    out = stages.evaluate(table81, made["table"], found, ["n"])
    c = out["confusion"].first()
    assert c.tp + c.fn == sum(e["n_rows"] for e in made["events"]) and c.tp + c.fp + c.tn + c.fn == 240
    assert out["events"].count() == 2 and out["paired"].where("effect_context = 'none' and abs(score_delta) > 1e-12").isEmpty()
    facts = stages.review_copy(table81, made["table"], S.MEASUREMENTS, ["n"])
    assert {tuple(r["columns"]) for r in facts["changed"].collect()} <= {("Array_Voltage", "Power_Generated"), ("Air_Temp",), ("Relative_Humidity",)}


def test_compare_and_stability(table81):
    parts = stages.split(table81, BOUNDS, "n")["table"]
    found = stages.compare(parts, {"core": review.CORE, "no_time": review.NO_TIME}, "n", (0.45, 0.35, 0.15, 0.05), "low_light_context", trees=10, sample=64)
    assert found["evidence"].count() == 2 and found["choice"].count() == 1 and found["overlap"].first().top_10_overlap <= 10
    calm = stages.stability(parts, review.NO_TIME, "n", [1, 2, 3], -1.0, -1.0, 0.0, trees=10, sample=64)
    assert calm["pairs"].count() == 3 and calm["gates"].first().freeze


def test_split_rejects_gaps_and_labels(table81):
    with pytest.raises(ValueError, match="60 rows in no partition"):
        stages.split(table81, BOUNDS[:2], "n")
    with pytest.raises(ValueError, match="labels"):
        stages.split(table81, BOUNDS, "n", ["synthetic_anomaly"])


def test_clean_and_verbatim_sinks(spark, tmp_path):
    (tmp_path / "b").mkdir()
    head = "Timestamp,Power_Generated,Note\n"
    (tmp_path / "b" / "two.csv").write_text(head + "1-5-2022 0:04,3.50,z\n1-5-2022 0:00,x,y\n")
    (tmp_path / "a.csv").write_text(head + "01-05-2022 00:02,1.10,n\n01-05-2022 00:02,1.10,n\n")
    raw = operational.read_text_columns(spark, f"file://{tmp_path}")
    assert [r.Note for r in raw.orderBy("_pos").collect()] == ["n", "n", "z", "y"]  # files by path, rows as they stand
    out = stages.clean(spark, f"file://{tmp_path}", ["Power_Generated"])
    assert [r.Power_Generated for r in out["table"].orderBy("Timestamp").collect()] == [None, 1.1, 3.5]
    p = out["profile"].first()
    assert (p.n, p.backward, p.duplicates, p.median_gap) == (3, 1, 0, 120.0)
    s = out["summary"].first()
    assert (s.unreadable, s.missing, s.missing_after) == (1, 0, 1)
    both = reports.appended(raw, raw.select("_pos", (F.col("_pos") / 3).alias("third")), ["third"])
    assert [r.Power_Generated for r in both.orderBy("_pos").collect()] == ["1.10", "1.10", "3.50", "x"]
    assert float(both.where("_pos = 1").first().third) == 1 / 3
    old = raw.select("_pos", F.lit(1.1).alias("Power_Generated"))
    new = old.withColumn("Power_Generated", F.when(F.col("_pos") == 2, 0.1).otherwise(F.col("Power_Generated")))
    cells = [r.Power_Generated for r in reports.rewritten(raw, old, new, ["Power_Generated"]).orderBy("_pos").collect()]
    assert (cells[0], cells[1], float(cells[2]), cells[3]) == ("1.10", "1.10", 0.1, "x")
    reports.write_text(spark, "a: 1\nb: [2]", f"file://{tmp_path}/c.yaml")
    assert "| 3 | 4 |" in reports.markdown("t", {"one": spark.createDataFrame([(3, 4)], "x int, y int")})


def test_pinned_scan(spark, tmp_path, plant):
    reports.write_csv(plant.select(*S.S14).orderBy("n").coalesce(1), f"file://{tmp_path}/x")
    back = operational.scan_pinned(spark, f"file://{tmp_path}/x", S.S14)
    assert back.count() == 240 and dict(back.dtypes)["Timestamp"] == "timestamp_ntz"
    with pytest.raises(ValueError, match="layout"):
        operational.scan_pinned(spark, f"file://{tmp_path}/x", S.S31)
    bad = plant.select(*(F.lit("oops").alias(c) if c == "Air_Temp" else F.col(c) for c in S.S14))
    reports.write_csv(bad.coalesce(1), f"file://{tmp_path}/y")
    with pytest.raises(ValueError, match="unreadable_Air_Temp in 240"):
        operational.scan_pinned(spark, f"file://{tmp_path}/y", S.S14)


def test_quarantine_moves_and_rolls_back(spark, tmp_path):
    for name in ("train/images/a.jpg", "train/labels/a.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(" \n")
    root = f"file:{tmp_path}"
    review_rows = spark.createDataFrame([("train", f"{root}/train/images/a.jpg", "NEEDS_MANUAL_REVIEW", "true")], "split string, image_path string, review_status string, empty_label string")
    files = reports.image_files(spark, str(tmp_path)).select("path", "length", "sha256", F.lit(None).cast("boolean").alias("blank"))
    files = files.unionByName(reports.label_files(spark, str(tmp_path)).select("path", F.length("text").cast("long").alias("length"), "sha256", (F.trim(F.regexp_replace("text", r"\s", "")) == "").alias("blank")))
    plan = reports.quarantine_plan(review_rows, files, root="q").withColumn("quarantine_image_path", F.lit(f"{root}/q/a.jpg")).withColumn("quarantine_label_path", F.lit(f"{root}/q/a.txt"))
    assert plan.first().problem is None
    (tmp_path / "m").mkdir()
    with pytest.raises(Exception):
        reports.carry_out(plan, f"{root}/m")  # the manifest's folder exists: everything moves back
    assert (tmp_path / "train/images/a.jpg").exists() and (tmp_path / "train/labels/a.txt").exists()
    assert reports.carry_out(plan, f"{root}/manifest") == 2
    assert (tmp_path / "q/a.jpg").exists() and not (tmp_path / "train/images/a.jpg").exists()


def test_configurations():
    split = {
        "schema_version": 1, "dataset": {"timestamp_column": "Timestamp"}, "split_policy": {"random_shuffle": False}, "context": {"low_light_threshold_w_m2": 5.0}, "core_features": list(review.CORE),
        "partitions": {"training": {"start": "2022-04-27 15:32:00", "end": "2022-04-28 02:42:00"}, "calibration": {"start": "2022-04-28 02:44:00", "end": "2022-04-28 13:54:00"}},
    }
    assert configs.check("split", split) is split
    split["partitions"]["calibration"]["start"] = "2022-04-28 02:42:00"
    with pytest.raises(ValueError, match="partitions.*without overlap"):
        configs.check("split", split | {"schema_version": 2})
    drop = {"enabled": True, "duration_samples": [1, 3], "duration_minutes": [2, 6], "affected_variables": ["Power_Generated", "Array_Voltage"], "context_rule": "power_daylight", "severity": {"range": [0.1, 0.3]}}
    sensor = drop | {"affected_variables": ["Air_Temp", "Relative_Humidity"], "context_rule": "finite_sensor_any_light", "severity": {"direction_choices": [-1, 1], "magnitude_ranges": {"Air_Temp": {"range": [2, 5]}}}}
    every = {n: drop for n in configs.SCENARIOS} | {"radiation_power_inconsistency": drop | {"affected_variables": ["Solar_Radiation"]}, "sensor_excursion": sensor}
    assert configs.good_scenarios(every) and not configs.good_scenarios(dict(reversed(every.items()))) and not configs.good_scenarios({"sudden_power_drop": drop})
    wrong = lambda name, **change: configs.broken_scenarios({name: every[name] | change})
    assert wrong("sudden_power_drop") == [] == wrong("sensor_excursion")
    assert wrong("sudden_power_drop", duration_minutes=[2, 5], enabled=1) == ["sudden_power_drop: enabled: yes or no", "sudden_power_drop: duration_minutes: two minutes a row"]
    for severity, names in (({"range": [0.1, 1.0]}, ("sudden_power_drop",)), ({"range": [0, 0]}, ("sudden_power_drop", "sudden_power_spike")), ({"range": [0.3, 0.1]}, ("temporary_near_zero_power",)), ({}, ("sudden_power_drop",))):
        assert all(wrong(n, severity=severity) for n in names)
    assert not wrong("temporary_near_zero_power", severity={"range": [0, 0]})
    assert wrong("sensor_excursion", severity=sensor["severity"] | {"direction_choices": [1]}) and wrong("sensor_excursion", context_rule="power_daylight") and wrong("sudden_power_drop", affected_variables=["Power_Generated"])
    context = configs.CONTEXT_SETTINGS | {
        "minimum_gap_minutes": 60, "max_modified_row_fraction_per_copy": 0.05, "known_transition_exclusions": {"half_window_minutes": 20}, "power_event_min_radiation_w_m2": 100, "power_event_min_power_w": 5.0, "start_position": {"manual_override": None},
        "placement_window": {"start": "2022-04-27 00:00:00", "end": "2022-04-28 00:00:00"},
    }
    whole = {"schema_version": 1, "enabled": True, "core_features": list(review.CORE), "sampling_interval_seconds": 120, "scenarios": every, "context": context}
    assert configs.check("scenarios", whole) is whole and configs.check("scenarios", whole | {"context": {k: v for k, v in context.items() if k != "placement_window"}})
    for change in ({"placement_window": {"start": "2022-04-29", "end": "2022-04-28"}}, {"placement_window": {"start": "2022-04-27T00:00:00+02:00", "end": "2022-04-28"}}, {"overlap_allowed": 0}, {"require_finite_inputs": False}, {"power_event_min_power_w": 0}, {"start_position": {"manual_override": 4}}, {"eligibility_reference": "copy"}):
        with pytest.raises(ValueError, match="context"):
            configs.check("scenarios", whole | {"context": context | change})
    good = [{"id": "p", "strategy": "calibration_percentile", "percentile": 95.0}, {"id": "m", "strategy": "calibration_median_plus_k_mad", "k": 2.0}]
    assert configs.rules_of_thresholds(good) and not configs.rules_of_thresholds([good[0], good[0]])
    assert configs.dataset_classes({"names": {0: "a", 1: "b"}, "nc": 2, "train": "x", "val": "y"}) == ("a", "b")
    for wrong in ({"names": {1: "a"}}, {"names": ["a"], "nc": 2}, {"names": []}, {"names": ["a"], "train": "x"}):
        with pytest.raises(ValueError):
            configs.dataset_classes(wrong)


def test_examples_metrics_and_predictions(spark):
    sets = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["z"]), ("d", ["y", "x"])], "image string, classes array<string>")
    assert vision.pick_examples(sets, 3) == ["b", "c"]
    m = spark.createDataFrame([([0.5, 0.7], [0.1, 0.2], [0.3, 0.4], [0.2, 0.6])], "precision array<double>, recall array<double>, map50 array<double>, map50_95 array<double>")
    assert [r.class_name for r in vision.class_metrics(m, ["p", "q"]).collect()] == ["q", "p"]
    boxes = spark.createDataFrame([("a", "x", 0.2, 0.0, 0.0, 1.0, 1.0), ("a", "y", 0.9, 0.0, 0.0, 1.0, 1.0)], "image string, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {r.image: [d.class_name for d in r.detections] for r in vision.predictions_of(sets.select("image"), boxes).collect()}
    assert got == {"a": ["y", "x"], "b": [], "c": [], "d": []}
    line = spark.createDataFrame([("1.0 .5 .5 .1 .1",), ("1.5 .5 .5 .1 .1",)], "line string")
    assert [r.error for r in vision.parse_label_lines(line, "line", 6).collect()] == ["ok", "class_text"]

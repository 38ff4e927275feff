import csv
import json
import math
import os

import pytest

from pvlens.operators import vision
from pvlens.sources import detections

SCHEMA = "video string, frame_index long, detections array<struct<class_name: string, confidence: double>>"
FRAMES = [("b", 0, [("dust", 0.5), ("clean", math.nan)]), ("a", 0, []), ("a", 1, None), ("a", 2, [("dust", 0.9), ("dust", 0.25)])]
CLASSES = ["clean", "dust"]


@pytest.fixture(scope="module")
def log(spark):
    return vision.frame_log(spark.createDataFrame(FRAMES, SCHEMA), 2, 4.0).persist()


def lines(folder, name):
    parts = sorted(f for f in os.listdir(f"{folder}/{name}") if f.startswith("part-"))
    return [x for f in parts for x in open(f"{folder}/{name}/{f}")]


def test_three_outputs(log, tmp_path):
    out = str(tmp_path / "out")
    detections.write_results(log, out, CLASSES, 2, 4.0)
    assert sorted(os.listdir(out)) == ["detections", "frames", "summary"] and os.listdir(tmp_path) == ["out"]
    rows = [r for r in csv.reader(lines(out, "detections")) if r[0] != "video"]
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [("a", "2", "1", "dust"), ("a", "2", "2", "dust"), ("b", "0", "1", "dust"), ("b", "0", "2", "clean")]
    frames = [json.loads(x, parse_constant=pytest.fail) for x in lines(out, "frames")]
    assert [(f["video"], f["frame_index"], f["analysed"], f["n_detections"]) for f in frames] == [("a", 0, True, 0), ("a", 1, False, 0), ("a", 2, True, 2), ("b", 0, True, 2)]
    assert frames[1]["detections"] == [] and frames[3]["detections"][1] == {"class_name": "clean", "confidence": None}
    a, b = sorted((json.loads(x) for x in lines(out, "summary")), key=lambda r: r["video"])
    assert (a["frames"], a["analysed"], a["duration_seconds"], a["total_detections"]) == (3, 2, 0.75, 2)
    assert (a["detections_by_class"], a["frames_by_class"], a["highest_by_class"]) == ({"clean": 0, "dust": 2}, {"clean": 0, "dust": 1}, {"clean": None, "dust": 0.9})
    assert (b["total_detections"], b["detections_by_class"], b["highest_by_class"]) == (2, {"clean": 1, "dust": 1}, {"clean": None, "dust": 0.5})


def test_nothing_is_left_of_a_failed_write(spark, log, tmp_path):
    with pytest.raises(ValueError, match="no frame"):
        detections.write_results(log.limit(0), str(tmp_path / "none"), CLASSES, 2, 4.0)
    (tmp_path / "there").mkdir()
    with pytest.raises(Exception):
        detections.write_results(log, str(tmp_path / "there"), CLASSES, 2, 4.0)
    assert os.listdir(tmp_path) == ["there"] and os.listdir(tmp_path / "there") == []

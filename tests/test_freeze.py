"""A chain of frozen steps: an altered choice, manifest or file stops what follows."""

import json

import pytest
from pyspark.sql import functions as F

from pvlens.operators import freeze
from pvlens.operators.freeze import Frozen
from pvlens.plans import stages


def test_chain(spark, tmp_path):
    folder = str(tmp_path / "chain")
    assert freeze.verified(spark, folder) == []
    freeze.freeze(spark, folder, "variant", ["no_time"], {"training": "abc"})
    freeze.freeze(spark, folder, "threshold", {"rule": "p99", "value": (0.61).hex()})
    assert [x["step"] for x in freeze.verified(spark, folder)] == ["variant", "threshold"]
    with pytest.raises(Frozen, match="already"):
        freeze.freeze(spark, folder, "variant", ["core"])
    rows = spark.createDataFrame([("evaluation", 1), ("training", 2)], "partition string, x int")
    assert freeze.opened(rows, F.col("partition") == "evaluation", folder, "variant", ["no_time"], {"training": "abc"}).count() == 1
    for choice, inputs, said in ((["core"], None, "another choice"), (["no_time"], {"training": "abd"}, "other inputs")):
        with pytest.raises(Frozen, match=said):
            freeze.opened(rows, F.col("x") > 0, folder, "variant", choice, inputs)
    with pytest.raises(Frozen, match="not frozen"):
        freeze.demanded(spark, folder, "detector", {})
    first = tmp_path / "chain" / "0000-variant.json"
    text = first.read_text()
    for altered in (text.replace("abc", "abd"), text.replace("no_time", "core"), "{", json.dumps(json.loads(text) | {"before": "x"}, sort_keys=True)):
        first.write_text(altered)
        for crc in (tmp_path / "chain").glob(".*.crc"):
            crc.unlink()
        with pytest.raises(Frozen):
            freeze.demanded(spark, folder, "threshold", {"rule": "p99", "value": (0.61).hex()})
    first.write_text(text)
    assert freeze.demanded(spark, folder, "threshold", {"rule": "p99", "value": (0.61).hex()})["step"] == "threshold"


def test_protected_files(spark, tmp_path):
    data = tmp_path / "data" / "deep"
    data.mkdir(parents=True)
    for name in ("a.csv", "b.csv", "c.csv"):
        (data / name).write_text(name)
    before = spark.createDataFrame(freeze.snapshot(spark, [str(tmp_path / "data")]).collect())
    freeze.unharmed(before, spark, [str(tmp_path / "data")])
    (data / "a.csv").write_text("other")
    (data / "b.csv").unlink()
    (data / "d.csv").write_text("new")
    got = {r.path.rsplit("/", 1)[1]: r.change for r in freeze.touched(before, freeze.snapshot(spark, [str(tmp_path / "data")])).collect()}
    assert got == {"a.csv": "changed", "b.csv": "removed", "d.csv": "added"}
    with pytest.raises(Frozen, match="a.csv changed"):
        freeze.unharmed(before, spark, [str(tmp_path / "data")])


def test_evaluate_demands_the_frozen_detector(spark, tmp_path):
    class Other:
        def hashes(self):
            return {"threshold": "2"}

    folder = str(tmp_path / "chain")
    freeze.freeze(spark, folder, "detector", {"threshold": "1"})
    rows = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(Frozen, match="another choice"):
        stages.evaluate(rows, rows, Other(), ["x"], chain=folder)


def test_choices(spark):
    rows = spark.createDataFrame([("p99", 0.1, None), ("p95", 0.3, 1)], "rule string, threshold double, n int")
    assert freeze.choice_of(rows) == freeze.choice_of(rows.orderBy("rule"))
    with pytest.raises(ValueError):
        freeze.choice_of(spark.range(100))

import numpy as np

from pvlens.plans import catalogue


def test_row_isolated_in_a_late_component(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(250, 20))
    x[17, :8] = 0.0
    x[17, 8:] = 9.0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.anomaly_score for r in catalogue.queries()["iforest_fit_score"](spark, str(tmp_path)).collect()}
    assert max(got, key=got.get) == 17

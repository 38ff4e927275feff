import numpy as np
import pytest

from pvlens.llm import topk


# The distances of about half of the rows to the outlier are rounded up as 32-bit floats, of the others down.
@pytest.mark.parametrize("outlier,middle", [(1e7, 0.5), (1e10, 512.0)])
def test_near_copies_beside_an_outlier(spark, outlier, middle):
    rng = np.random.default_rng(4)
    base = np.round(rng.normal(size=8) * 64) / 64
    base[2] = middle
    x = base + np.round(rng.normal(size=(2000, 8)) * 3) / 64
    x[7, 2] = outlier
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_topk(df, block_rows=64).collect())
    v = np.floor(x * 64).astype(np.int64)
    scores = v[::20] @ v.T
    want = []
    for n, q in enumerate(range(0, len(x), 20)):
        found = sorted((-int(s), i) for i, s in enumerate(scores[n]) if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert got == want

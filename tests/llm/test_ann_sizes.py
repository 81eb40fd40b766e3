import numpy as np
import pytest

from caselode.llm import ann


@pytest.mark.parametrize("size", [1.0, 1e25, 1e120, 1e-60])
def test_numbers_of_any_size(spark, size):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 12)) * size
    x[::50] *= 1e-6
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(rows, candidates=25, row_block=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(axis=1)
        want = sorted((j for j in range(600) if j != q), key=lambda j: (-s[j], j))[:20]
        assert [v for _, v in sorted(got[q])] == want

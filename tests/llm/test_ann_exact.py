import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from caselode.llm import ann


def test_exact_where_a_fixed_number_of_candidates_misses(spark, tmp_path):
    n, ids = 20_000, np.arange(20_000)
    x = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    pq.write_table(pa.table({"vec_id": ids, "embedding": list(x)}), tmp_path / "v.parquet")
    rows = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = ann.search(rows, queries=lambda i: i % 400 == 0).collect()
    mine = {q: [] for q in range(0, n, 400)}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        mine[r.query_id].append(r.vec_id)
    for q, found in mine.items():
        s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        s[q] = -np.inf
        assert found == sorted(ids, key=lambda j: (-s[j], j))[:20]

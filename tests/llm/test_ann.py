import numpy as np
import pytest

from caselode.llm import ann


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = (x * q).sum(axis=1)
            order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:k]
            out[i] = [(ids[j], s[j]) for j in order]
    return out


def recall(got, want):
    hit = total = 0
    for q, best in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert all(a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id) for a, b in zip(mine, mine[1:], strict=False))
        floor = best[-1][1] - 1e-9
        hit += sum(r.score >= floor for r in mine)
        total += len(best)
    return hit / total


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.tolist(), np.stack(rows.embedding).astype(float)
    got = ann.query(spark, f"/root/testdata/{sf}").collect()
    assert recall(got, brute(ids, x)) >= 0.95
    at = dict(zip(ids, x, strict=True))
    assert all(abs(r.score - (at[r.query_id] * at[r.vec_id]).sum()) < 1e-12 for r in got)


def test_edge_rows_and_ties(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(1, 40)]
    same = [(100 + i, [9.0, 0.0, 0.0, 0.0, 0.0, -0.0]) for i in range(60)]
    bad = [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (300, []), (320, [1.0]), (None, [1.0] * 6)]
    rows = spark.createDataFrame([(i, v, 0) for i, v in good + same + bad], "vec_id long, embedding array<float>, key int")
    got = ann.search(rows, row_block=32, query_block=3).collect()
    ids = [i for i, _ in good + same]
    x = np.array([v for _, v in good + same], np.float32).astype(float)
    want = brute(ids, x)
    assert recall(got, want) == 1
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 120), key=lambda r: r.rank)] == [i for i, _ in want[120]]
    assert ann.search(rows.limit(0)).count() == 0
    few = ann.search(rows.where("vec_id in (20, 40, 1)")).collect()
    assert [r.vec_id for r in few] == [1]


def test_codes_weigh_the_parallel_error():
    x = np.random.default_rng(1).normal(size=(2000, 16))
    books, eta = ann.fit_codebooks(x, threshold=0.5)
    plain, _ = ann.fit_codebooks(x, threshold=0.0)
    part = np.arange(8)

    def parallel(b, e):
        r = x - b[part, ann.encode(x, b, e)].reshape(len(x), -1)
        return np.mean(((r * x).sum(axis=1) / np.linalg.norm(x, axis=1)) ** 2)

    assert eta > 1 and parallel(books, eta) < 0.6 * parallel(plain, 1.0)

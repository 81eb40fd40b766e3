"""Vectors of several lengths, repeated rows, and blocks left out by their norms."""

import numpy as np
import pytest

from caselode.llm import ann


def plain(rows, k=20, every=20):
    """(query_id, rank, vec_id, score): every row but the query's own, of the query's length."""
    out = []
    for i, (q, x) in enumerate(rows):
        if q % every == 0:
            found = [(-float(np.dot(np.float64(x), np.float64(y))), v) for j, (v, y) in enumerate(rows) if j != i and len(y) == len(x)]
            out += [(q, n, v, -s) for n, (s, v) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def search(spark, rows, **options):
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "vec_id long, embedding array<double>")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, **options).collect())


def test_minority_lengths_and_repeated_rows(spark):
    rows = [(0, [1, 2, 3]), (1, [2, 0, 1]), (1, [2, 0, 1]), (2, [1, 1, 1]), (20, [4, 5]), (3, [1, 7])]
    assert search(spark, rows) == plain(rows)
    rows += [(20, [4, 5]), (20, [1, 1, 1]), (40, [1]), (60, [2, 0, 1]), (60, [2, 0, 1])]
    got = search(spark, rows)
    assert got == plain(rows)
    assert [r[2] for r in got if r[0] == 20].count(20) == 2  # each copy is a candidate of the other


@pytest.mark.parametrize("k", [3, 20])
def test_many_copies(spark, k):
    rng = np.random.default_rng(3)
    base = [rng.integers(-3, 4, 4).tolist() for _ in range(6)]
    rows = [(i % 45, base[i % 6 if i % 3 else 0]) for i in range(200)]
    rows = [(i, x) for i, x in rows if any(x)]
    assert search(spark, rows, k=k, row_block=2) == plain(rows, k)


@pytest.mark.parametrize("row_block", [40, 1 << 20])
def test_norms_of_many_sizes(spark, row_block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8)) * np.exp(rng.normal(size=(700, 1)) * 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = search(spark, rows, row_block=row_block, candidates=30)
    assert [r[:3] for r in got] == [r[:3] for r in plain(rows)]


def test_few_large_vectors_among_many_small_ones(spark):
    """The results lie in the first level, but a small query's own place doesn't."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 8))
    x[:60] *= 1e6
    x[0] *= 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = plain(rows, every=400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, queries=lambda i: i % 400 == 0, row_block=50)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == [r[:3] for r in want]

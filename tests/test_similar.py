"""Clusters across buckets against all pairs."""

import numpy as np
import pytest

from caselode.operators import similar as S


def plain(ids, x, threshold):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero(near[i]):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if v in (a, b) else v for v in label]
    groups = {}
    for i, root in enumerate(label):
        groups.setdefault(root, []).append(ids[i])
    return sorted((i, min(g), len(g)) for g in groups.values() for i in g)


def made(seed, n=300, d=16, noise=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, d))
    return list(range(n)), centres[rng.integers(0, 25, n)] + noise * rng.normal(size=(n, d))


def run(spark, ids, x, threshold, **options):
    df = spark.createDataFrame([(i, [float(c) for c in v], "z") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, key string")
    return sorted(map(tuple, S.similar_clusters(df, threshold, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"hot": 20}, {"bucket": 8, "target": 0.9999}])
def test_components_equal_those_of_all_pairs(spark, options):
    ids, x = made(1)
    assert run(spark, ids, x, 0.85, **{"target": 0.9999, **options}) == plain(ids, x, 0.85)


def test_recall_of_pairs_and_no_wrong_link():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4000, 32))
    x = base + 0.45 * rng.normal(size=base.shape)
    a, b = (v / np.linalg.norm(v, axis=1)[:, None] for v in (base, x))
    over = (a * b).sum(axis=1) >= 0.9
    bits, tables = S.tables_for(1_000_000, 0.9, 0.95)
    planes = np.random.default_rng([0, 32]).normal(size=(tables * bits, 32))
    code = lambda v: (v @ planes.T > 0).reshape(len(v), tables, bits)
    met = (code(a) == code(b)).all(axis=2).any(axis=1)
    assert over.sum() > 500 and met[over].mean() >= 0.9 and bits >= 8


def test_copies_lengths_and_bad_vectors(spark):
    x = [[1.0, 0.0]] * 40 + [[1.0, 0.01], [0.0, 1.0], [5.0], [0.0, 0.0], [], [float("nan"), 1.0]]
    got = run(spark, range(len(x)), x, 0.99, hot=3)
    assert got == sorted([(i, 0, 41) for i in range(41)] + [(41, 41, 1), (42, 42, 1)])
    assert run(spark, [], [], 0.9) == []

import itertools

import numpy as np
import pytest

from caselode.llm import quality, toxicity

DOCS = "doc_id long, text string, score double, label int"


def brute(good, edges):
    n = len(good)
    total, one, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        v = np.exp(sum(g for g, b in zip(good, y, strict=True) if b) + sum(edges[a, b] for a, b in itertools.pairwise(y)))
        total += v
        one += v * np.array(y)
        for a, b in itertools.pairwise(y):
            pairs[a, b] += v
    return one / total, np.log(total), pairs / total


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    per_text = np.array([3, 1, 6, 2])
    good, edges = rng.normal(size=12) * 3, rng.normal(size=(2, 2))
    p, log_z, pairs = quality.marginals(per_text, good, edges)
    at = 0
    for i, n in enumerate(per_text):
        want = brute(good[at : at + n], edges)
        assert np.allclose(p[at : at + n], want[0]) and np.isclose(log_z[i], want[1]) and np.allclose(pairs[i], want[2])
        at += n


def test_gradient():
    rng = np.random.default_rng(1)
    per_text, y = np.array([4, 1, 2]), np.array([1, 0, 1])
    x, theta = rng.normal(size=(7, quality.WIDTH)), rng.normal(size=quality.WIDTH + 5) * 0.2
    got = quality._gradient(theta, per_text, x, y)
    for k in [0, 5, quality.WIDTH, *range(quality.WIDTH + 1, quality.WIDTH + 5)]:
        step = np.zeros_like(theta)
        step[k] = 1e-5
        up, down = (quality._gradient(theta + s, per_text, x, y)[0] for s in (step, -step))
        assert np.isclose((up - down) / 2e-5, got[1 + k], atol=1e-5)


def test_line_features_see_lines_and_neighbours():
    per_text, size, x = quality.line_features(["Ab 1!\n\nthe the the", "", "Ab 1!\nAb 1!"])
    assert per_text.tolist() == [3, 1, 2] and size.tolist() == [5, 0, 11, 0, 5, 5]
    own = quality.OWN
    assert np.isclose(x[0, 0], 1 / 5) and np.isclose(x[2, len(quality.CLASSES) + 1], 2 / 3)
    assert (x[1, own : 2 * own] == x[0, :own]).all() and (x[4, own : 2 * own] == 0).all()
    assert x[0, 3 * own] == 1 and x[2, 3 * own + 1] == 1 and x[1, 3 * own] == 0
    repeated = len(quality.CLASSES) + 1 + 5
    assert x[:, repeated].tolist() == [0, 0, 0, 0, 1, 1]


@pytest.mark.parametrize(("module", "label", "mod", "held", "floor"), [(quality, "quality", 5, 0, 0.97), (toxicity, "toxic", 3, 1, 0.8)])
def test_held_out_rows(spark, module, label, mod, held, floor):
    import zlib

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    few = docs.where("doc_id < 4000")
    got = {r.doc_id: r for r in module.classify(few, labels).collect()}
    assert len(got) == 4000
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % mod == held) for d, r in got.items())
    out = [(got[d].score, y) for d, y in truth.items() if d in got and got[d].held_out]
    pos, neg = [s for s, y in out if y], [s for s, y in out if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > floor and all(0 <= s <= 1 for s, _ in out)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_rows(spark, module):
    docs = spark.createDataFrame(
        [(1, "a fine text of words", 0.0, 1), (2, None, 0.0, 0), (3, "", 0.0, 0), (None, "XX!! XX!!", 0.0, 0), (3, "", 0.0, 0), (4, "w " * 200_000, 0.0, 1)], DOCS
    )
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (4, 0, 1), (4, 1, 0), (None, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "4", "None"] and all(0 <= r.score <= 1 for r in got)
    none = module.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and module.classify(docs.limit(0), labels).count() == 0

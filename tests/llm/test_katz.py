import math
import random
import zlib
from collections import Counter

import pytest

from caselode.llm.katz import K, discounts, score_texts


def plain(rows):
    """The same model from dictionaries, and each context's sum over all words."""
    tokens = [[w for w in (t or "").encode().lower().split()] + [None] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    one, two = Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            one.update(t)
            two.update(zip([None, *t], t, strict=False))
    n = sum(one.values())
    d1, d2 = (discounts([sum(v == r for v in c.values()) for r in range(1, K + 2)]) for c in (one, two))
    left = 1 - sum(d1[min(c, K + 1)] * c / n for c in one.values())
    scale, unknown = (1.0, left) if left > 1e-12 else (n / (n + 1), 1 / (n + 1))
    p1 = lambda w: scale * d1[min(one[w], K + 1)] * one[w] / n if one[w] else unknown
    after = {}
    for a, b in two:
        after.setdefault(a, []).append(b)

    def p(w, h):
        if not one[h]:
            return p1(w)
        if two[h, w]:
            return (d2[two[h, w]] * two[h, w] if two[h, w] <= K else two[h, w] - 0.5) / one[h]
        seen = after[h]
        return (1 - sum(p(x, h) for x in seen)) / (1 - sum(map(p1, seen))) * p1(w)

    for h in [None, *list(one)[:20], "never"]:
        assert math.isclose(sum(p(w, h) for w in [*one, "never"]), 1, rel_tol=1e-9)
    out = []
    for (i, _), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (len(one) + 1))) for w in t)
        out.append((i, h, len(t), sum(one[w] > 0 for w in t), n, base, sum(math.log10(p(w, a)) for a, w in zip([None, *t], t, strict=False))))
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 900])
def test_scores_against_dictionaries(spark, chunk_bytes):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[min(59, int(rnd.expovariate(0.08)))] for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    rows += [(150, None), (151, ""), (None, "W1 w2\tw3"), (7, rows[7][1]), (152, "né NÉ\x0bw1\xa0w2"), (153, "w1 " * 4000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, chunk int")
    got = sorted((tuple(r) for r in score_texts(docs, chunk_bytes=chunk_bytes).collect()), key=repr)
    for g, w in zip(got, sorted(plain(rows), key=lambda r: repr(r)), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-8) and g[6] == pytest.approx(w[6], abs=1e-7)


def test_edges(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, r.score) for r in score_texts(docs).collect()} == {(0, 0, 0.0)}
    assert score_texts(docs.limit(0)).count() == 0


def test_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {r[0]: r for r in plain(rows)}
    got = score_texts(docs, chunk_bytes=60_000).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert tuple(r)[:5] == w[:5] and r.base_score == pytest.approx(w[5], abs=1e-6) and r.score == pytest.approx(w[6], abs=1e-6)


def test_contexts_whose_followers_are_all_frequent(spark):
    """Contexts of one and of seven followers, each far above K: finite weights, and each context still sums to one (`plain` asserts that)."""
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    learned = [i for i in range(2000, 4000) if zlib.crc32(str(i).encode()) % 10][:404]
    rows = [(i, f"xx yy common{k % 7}") for k, i in enumerate(learned[:54])]
    rows += [(i, f"zz f{k % 7} common{k % 3}") for k, i in enumerate(learned[54:])]
    rows += [(held, "xx zz common1"), (held, "zz new yy"), (held, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r[0], r[2], round(r[6], 6)) for r in plain(rows))
    for chunk_bytes in (1 << 24, 700, 60):
        got = score_texts(docs, chunk_bytes=chunk_bytes).collect()
        assert sorted((r.doc_id, r.n_tokens, round(r.score, 6)) for r in got) == want
    assert min(s for i, _, s in want if i == held) > -15

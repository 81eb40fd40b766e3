import math
import random
import zlib
from collections import Counter

import pytest

from caselode.llm.katz import K, discounts, score_texts


def plain(rows, order):
    """A model of any order from dictionaries, evaluated recursively, and each context's sum over all words."""
    tokens = [[w for w in (t or "").encode().lower().split()] + [None] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = [None] + [Counter() for _ in range(order)]
    for t, h in zip(tokens, held, strict=True):
        if not h:
            whole = (None, *t)
            counts[1].update((w,) for w in t)
            for n in range(2, order + 1):
                counts[n].update(whole[i : i + n] for i in range(len(whole) - n + 1))
    n_train = sum(counts[1].values())
    d = [None] + [discounts([sum(v == r for v in c.values()) for r in range(1, K + 2)]) for c in counts[1:]]
    left = 1 - sum(d[1][min(c, K + 1)] * c / n_train for c in counts[1].values())
    scale, unknown = (1.0, left) if left > 1e-12 else (n_train / (n_train + 1), 1 / (n_train + 1))
    followers = {}
    for c in counts[2:]:
        for gram in c:
            followers.setdefault(gram[:-1], []).append(gram[-1])
    context_count = lambda h: sum(counts[len(h) + 1][(*h, w)] for w in followers.get(h, []))

    def p(w, h):
        if not h:
            c = counts[1][(w,)]
            return scale * d[1][min(c, K + 1)] * c / n_train if c else unknown
        c, seen = counts[len(h) + 1][(*h, w)], followers.get(h)
        if not seen:
            return p(w, h[1:])
        if c:
            return (d[len(h) + 1][c] * c if c <= K else c - 0.5) / context_count(h)
        return (1 - sum(p(x, h) for x in seen)) / (1 - sum(p(x, h[1:]) for x in seen)) * p(w, h[1:])

    vocabulary = [*(w for (w,) in counts[1]), b"never"]
    for h in list(followers)[:: max(1, len(followers) // 40)]:
        assert math.isclose(sum(p(w, h) for w in vocabulary), 1, rel_tol=1e-9)
    out = []
    for (i, _), t, h in zip(rows, tokens, held, strict=True):
        whole = (None, *t)
        score = sum(math.log10(p(w, whole[max(0, k + 1 - (order - 1)) : k + 1])) for k, w in enumerate(t))
        out.append((i, h, len(t), score))
    return out


@pytest.mark.parametrize(("order", "chunk_bytes"), [(2, 900), (3, 1 << 24), (3, 900), (4, 900)])
def test_orders_against_dictionaries(spark, order, chunk_bytes):
    rnd = random.Random(order)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(words[min(24, int(rnd.expovariate(0.2)))] for _ in range(rnd.randint(0, 25)))) for i in range(120)]
    rows += [(150, None), (151, ""), (None, "W1 w2\tw3"), (7, rows[7][1]), (152, "w1 w1 w1 new"), (153, "w1 w0 " * 300)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, chunk int")
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.score) for r in score_texts(docs, order=order, chunk_bytes=chunk_bytes).collect()), key=repr)
    for g, w in zip(got, sorted(plain(rows, order), key=repr), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-7)


def test_longer_contexts_know_held_out_copies_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    two, three = ({r.doc_id: r.score for r in score_texts(docs, order=n).where("not held_out").collect()} for n in (2, 3))
    assert sum(three.values()) > sum(two.values())

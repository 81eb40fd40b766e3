import random

import pytest
from pyspark.sql import functions as F

from caselode.llm import line_dedup as ld


def longest_previous(texts, m):
    """{(text, line): number of lines from there that an earlier suffix shares too}, where at least m."""
    suffixes = [(d, p, lines[p:]) for d, lines in enumerate(texts) for p in range(len(lines))]
    out = {}
    for i, (d, p, a) in enumerate(suffixes):
        best = 0
        for _, _, b in suffixes[:i]:
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            best = max(best, n)
        if best >= m:
            out[d, p] = best
    return out


@pytest.mark.parametrize(("seed", "m"), [(0, 2), (1, 3)])
def test_runs_against_enumeration(spark, seed, m):
    rnd = random.Random(seed)
    texts = [[rnd.choice("abc") for _ in range(rnd.randint(1, 7))] for _ in range(14)]
    texts += [texts[3] + texts[5], ["z"] + texts[3] + ["y"] + texts[5][:3]]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    longest = longest_previous(texts, m)
    want = {(d, q) for (d, p), n in longest.items() for q in range(p, p + n)}
    got = ld.repeated_runs(docs, min_lines=m, min_words=None).collect()
    assert {(r.doc_id, q) for r in got for q in range(r.start, r.start + r.n_lines)} == want
    for r in got:
        assert texts[r.doc_id][r.start : r.start + r.n_lines] == texts[r.first_doc_id][r.first_start : r.first_start + r.n_lines]
        assert (r.first_doc_id, r.first_start) < (r.doc_id, r.start)
        others = [(x.start, x.start + x.n_lines) for x in got if x.doc_id == r.doc_id and x != r]
        assert not any(a <= r.start and r.start + r.n_lines <= b for a, b in others)
    copies = {(r.doc_id, r.pos): r.span for r in ld.later_copies(ld.numbered(docs), m, None).groupBy("doc_id", "pos").agg(F.max("span").alias("span")).collect()}
    assert copies.keys() == longest.keys()
    for at, n in longest.items():  # known to the last doubling, or whole where the text ends
        assert copies[at] <= n < 2 * max(copies[at], m)

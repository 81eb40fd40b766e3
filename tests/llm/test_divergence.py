import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from caselode.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(data, least=30, top=50):
    """(lang, source, part, item, value, rank) from dictionaries, every term against every source."""
    docs, n, langs = Counter(), Counter(), {}
    for _, text, lang, source, _ in data:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        langs.setdefault(lang, {}).setdefault(source, 0)
        docs.update((lang, w) for w in set(words))
        n.update((lang, source, w) for w in words)
    out = []
    for lang, sources in langs.items():
        kept = [w for (x, w), d in docs.items() if x == lang and d >= least]
        total = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        share = lambda c, t: 1 + 10**9 * (c + 5) // (t + 5 * len(kept))
        p = {s: [share(n[lang, s, w], total[s]) for w in kept] for s in sources}
        q = [share(sum(n[lang, s, w] for s in sources), sum(total.values())) for w in kept]
        for s in sources:
            found = [(-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s]
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(sorted(found), 1)]
            found = [(b - a, w.encode()) for a, b, w in zip(p[s], q, kept, strict=True) if a > b and n[lang, s, w]]
            out += [(lang, s, "term", w.decode(), -v, i) for i, (v, w) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def made(seed, n=400):
    rnd = random.Random(seed)
    words = ["the", "The", "été", "ß", "a1b", "x-y", "日本", "q\x00r"] + [f"w{chr(97 + i)}" for i in range(20)]
    out = []
    for i in range(n):
        source = rnd.choice(["s0", "s0", "s0", "s1", "s2", "é", None, "s9"])
        own = words[: 4 + hash(source or "") % 3 * 8] if rnd.random() < 0.5 else words
        out.append((i, " ".join(rnd.choice(own) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "en", "de", None]), source, 0))
    return out + [(1, None, "en", "empty", None), (2, "", "xx", "s0", 0), (2, "few", "xx", "s1", 0), (3, "one", "yy", "s0", 0)] + [(5, "copy the copy", "en", "s1", 0)] * 3


@pytest.mark.parametrize("seed", range(2))
def test_against_dictionaries_and_sql(spark, seed):
    data = made(seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = plain(data)
    assert rows(D.audit(df)) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", data)
    assert sorted(con.execute(D.ORACLE_SQL).fetchall()) == want


def test_many_sources_and_few_terms(spark):
    rnd = random.Random(3)
    data = [(i, " ".join(rnd.choice("abcdefgh") * 2 for _ in range(6)), "en", f"s{rnd.randint(0, 60)}", 0) for i in range(500)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert rows(D.audit(df, least_docs=5, top=3)) == plain(data, least=5, top=3)


def test_nodes_are_the_distinct_beginnings():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        paths = sorted({tuple((int(g), int(rnd.integers(1, 3))) for g in np.flatnonzero(rnd.random(6) < 0.6)) for _ in range(40)} - {()})
        times = rnd.integers(1, 5, len(paths))
        lengths = np.array([len(x) for x in paths])
        flat = np.array([x for path in paths for x in path])
        got = {}
        first = np.cumsum(lengths) - lengths
        for depth, at, multiplicity in D.tree_nodes(lengths, first, flat[:, 0], flat[:, 1], times):
            for i, m in zip(at.tolist(), multiplicity.tolist(), strict=True):
                assert got.setdefault(paths[i][: depth + 1], m) == m
        want = Counter()
        for path, m in zip(paths, times.tolist(), strict=True):
            want.update({path[:k]: m for k in range(1, len(path) + 1)})
        assert got == dict(want)


def test_corrections_against_every_pair():
    rnd = np.random.default_rng(2)
    paths = sorted({tuple((int(g), int(rnd.integers(1, 4))) for g in np.flatnonzero(rnd.random(9) < 0.7)) for _ in range(80)} - {()})
    times = rnd.integers(1, 5, len(paths))
    flat = np.array([x for path in paths for x in path])
    item, count, p, base = flat[:, 0], flat[:, 1], flat[:, 1] * 7 + flat[:, 0], flat[:, 0] * 3
    want = Counter()
    for path, m in zip(paths, times.tolist(), strict=True):
        for i, (a, ca) in enumerate(path):
            for b, cb in path[i + 1 :]:
                pa_, pb, ba, bb = ca * 7 + a, cb * 7 + b, a * 3, b * 3
                want[a, b] += m * (abs(pa_ - pb) - abs(pa_ - bb) - abs(ba - pb) + abs(ba - bb))
    for most in (3, 1 << 20):
        lo, hi, value = D.pair_corrections(np.array([len(x) for x in paths]), item, count, p, base, times, most)
        assert {(a, b): v for a, b, v in zip(lo.tolist(), hi.tolist(), value.tolist(), strict=True)} == dict(want)


def test_long_texts_are_one_document(spark):
    data = [(i, "aa " * (50 + i) + "ab,", "en", f"s{i % 2}", 0) for i in range(40)]
    df = spark.createDataFrame(data, SCHEMA).repartition(1)
    want = sorted(map(tuple, D.term_counts(df).collect()))
    assert sorted(map(tuple, D.term_counts(df, block=10).collect())) == want
    assert {(r[2], r[3]) for r in want} == {("aa", 20), ("ab", 20)}


def test_empty_tables(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    got = rows(D.audit(spark.createDataFrame([(1, None, None, None, None), (2, "x", None, "s", 1)], SCHEMA)))
    assert got == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]

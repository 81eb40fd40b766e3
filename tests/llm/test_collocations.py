import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from caselode.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, least=10, longest=3, top=2000, absorbed=50):
    """(lang, rank, phrase, a, l, r, n, score) from dictionaries."""
    f, words = Counter(), Counter()
    for text, lang in rows:
        lang, text = "und" if lang is None else lang, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    around = Counter()
    for (lang, w), a in candidates.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                around[lang, w[i : i + n]] = max(around[lang, w[i : i + n]], a)
    found = {}
    for (lang, w), a in candidates.items():
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        if not 100 * around[lang, w] >= absorbed * a or not around[lang, w]:
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, rows_ in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def rows(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made(seed, n=300):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "C", "new", "York", "city", "é", "ß\x00", " ", "x1", "-"] + [f"r{i}" for i in range(40)]
    out = []
    for i in range(n):
        text = "".join(
            rnd.choice(["New York City", "a b", "b a", "a a a a", rnd.choice(vocabulary), rnd.choice(vocabulary)]) + rnd.choice([" ", " ", "\t", "  ", ", ", "\n", ". ", "\x0b", "\x1c"])
            for _ in range(rnd.randint(0, 25))
        )
        out.append((i, text, rnd.choice(["en", "en", "de", None]), "s", 0))
    return out + [(1, None, "en", None, None), (2, "", "fr", "s", 0), (3, "a b " * 2000, "en", "s", 0), (3, "a b " * 2000, "en", "s", 0)]


@pytest.mark.parametrize("shards", [1, 3, 4])
def test_against_dictionaries_and_sql(spark, shards):
    data = made(shards)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = plain([(t, lang) for _, t, lang, _, _ in data])
    assert rows(C.collocations(df, shards=shards)) == want
    if shards == 4:
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", data)
        assert sorted(con.execute(C.ORACLE_SQL).fetchall()) == want
        assert rows(C.collocations(df, top=7)) == plain([(t, lang) for _, t, lang, _, _ in data], top=7)


def test_longer_phrases_and_other_thresholds(spark):
    data = made(9, 120)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = plain([(t, lang) for _, t, lang, _, _ in data], least=4, longest=5, absorbed=80)
    assert rows(C.collocations(df, least=4, longest=5, absorbed=80, shards=2)) == want


def test_a_full_filter_and_small_blocks_change_nothing(spark):
    data = made(5)
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    f = lambda **k: sorted(map(tuple, C.frequent_phrases(df, **k)[0].collect()))
    want = f()
    assert f(cells=64) == want  # nearly every key seems to be marked
    assert f(block=50) == want


def test_pairs_are_counted_while_words_still_are():
    """The first pairs start after one shard of four, and see each shard once."""
    marks = np.full(1 << 12, C.Activated.NEVER, np.uint8)
    active = C.Activated(marks)
    tokens = C.Tokens.of([b"a b c. a b"], "en")
    again = C.Tokens.unpacked(*tokens.packed()[:4])
    assert again.at.tolist() == tokens.at.tolist() == [tokens.words.to_pylist().index(w) if w != "." else -1 for w in "a b c . a b".split()]
    seen = Counter()
    for step in range(10):
        for n, places, keys, times, _ in again.counted(3, step, 4, active):
            seen.update({(n, p, step): int(c) for p, c in zip(again.phrases(places, n).to_pylist(), times, strict=True)})
            if n < 3 and step == n - 1:
                for at in active.places(keys):
                    marks[at[marks[at] == C.Activated.NEVER]] = step + 1
    assert {s for n, p, s in seen if p == "a"} == {0, 1, 2, 3}
    assert {s for n, p, s in seen if p == "a b"} == {1, 2, 3, 4} and seen[2, "a b", 1] == 2
    assert {s for n, p, s in seen if p == "a b c"} == {2, 3, 4, 5}


def test_products_beyond_64_bits(spark):
    """Scores of large counts, by the same expression as the query's."""
    assert 10**6 * 10**14 * 10**14 > 2**64
    got = spark.sql("select (cast(100000000000000 as decimal(15,0)) * 1000000) as x").first()[0]
    assert int(got) == 10**20


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect() == []

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caselode.llm import simhash
from caselode.llm.components import connected_components
from caselode.llm.exact_dedup import drop_copies, exact_dedup

SCHEMA = "doc_id long, text string, h string, n int"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_exact_dedup_cases(spark):
    docs = spark.createDataFrame(
        [(1, "a", "x", 1), (2, "a", "y", 1), (3, "b", None, 2), (4, None, "z", 3), (5, "", "z", 3), (None, "c", "", 0), (3, "b", "", 0), (7, "a" * 300_000, "", 0)],
        SCHEMA,
    )
    got = rows_of(exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted(
        [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (3, 3, 2, False), (4, 5, 2, False), (5, 5, 2, True), (None, None, 1, True), (7, 7, 1, True)], key=repr
    )
    kept = rows_of(drop_copies(docs), "doc_id", "text")
    assert len(kept) == 5 and {k[0] for k in kept} == {2, 3, 5, 7, None}
    assert drop_copies(docs).columns == docs.columns
    assert exact_dedup(docs.limit(0)).count() == 0
    assert {r["keep_id"] for r in exact_dedup(docs.where("text = 'a'"), keep="min").collect()} == {1}


def test_exact_dedup_tells_colliding_texts_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "ab", "aa", "b", "ab", "ac"])], "doc_id long, text string")
    weak = exact_dedup(docs, content_hash=lambda t: F.substring(t, 1, 1).cast("binary"))
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(weak, *cols) == rows_of(exact_dedup(docs), *cols)


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    want = union_find(261, pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    seen = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in seen}


def simple_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "ÀB c\x0bd e", "x y z " * 9000, "a b c d e f g"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == simple_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.createDataFrame([("a b cé",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest("a b cé".encode(), 42)


def test_codes_are_perfect_coverings():
    for code in (simhash.GOLAY, simhash.HAMMING):
        first, _, excess = simhash._steps(code, 0)
        assert (np.diff(first) == 1).all() and (excess == 0).all()


def near_fingerprints(seed, n):
    rng = np.random.default_rng(seed)
    fps = [int(x) for x in rng.integers(0, 2**64, n, dtype=np.uint64)]
    for _ in range(3 * n):  # chains of small steps
        x = fps[rng.integers(0, len(fps))]
        for _ in range(rng.integers(1, 5)):
            x ^= 1 << int(rng.integers(0, 64))
        fps.append(x)
    return sorted(set(fps))


@pytest.mark.parametrize(("blocks", "hot"), [(1, 1 << 17), (2, 1 << 17), (1, 40)])
def test_links_connect_what_all_pairs_connect(spark, blocks, hot):
    fps = near_fingerprints(5, 150)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert len(pairs) > 100
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), blocks=blocks, hot=hot).collect()
    at = {x: i for i, x in enumerate(signed)}
    found = [(at[e.a], at[e.b]) for e in edges]
    assert union_find(len(fps), found) == union_find(len(fps), pairs)


def test_near_dedup_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(25)]
    for _ in range(60):
        t = texts[rng.integers(0, len(texts))].split()
        t[rng.integers(0, len(t))] = "new"
        texts.append(" ".join(t))
    texts += [None, "", "   ", "one", "ONE", texts[0]]
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    fps = [simple_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = [(3 * i, f"{fps[i]:016x}", 3 * r) for i, r in enumerate(union_find(len(fps), pairs))]
    assert rows_of(simhash.near_dedup(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[2] for w in want}
    assert simhash.near_dedup(docs.limit(0)).count() == 0
    one_null = spark.createDataFrame([(None, "q w e"), (None, "q w e")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_dedup(one_null).collect()] == [None, None]

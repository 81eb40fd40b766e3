import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from caselode.llm import packing


def check_plan(plan, counts, capacity):
    used = {}
    for items, times in plan:
        assert sum(items) <= capacity and times > 0
        for s in items:
            used[s] = used.get(s, 0) + times
    assert used == counts
    return sum(n for _, n in plan)


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i] and bins[k] not in bins[:k]:
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_small_plans_are_optimal(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(3, 60) for _ in range(rnd.randint(1, 13))]
    counts = {s: items.count(s) for s in set(items)}
    assert check_plan(packing.complete_bins(counts, 60), counts, 60) == optimum(items, 60)


@pytest.mark.parametrize("seed", range(4))
def test_large_plans_reach_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.8, 0.9, 200_000).astype(int), 1, 2048)
    values, n = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist(), strict=True))
    made = check_plan(packing.complete_bins(counts, 2048), counts, 2048)
    assert made <= packing.lower_bound(counts, 2048) * 1.001 + 1


def test_unpackable_large_items_meet_the_bound():
    counts = {1500: 1000, 1400: 7, 500: 100, 2048: 5}
    assert check_plan(packing.complete_bins(counts, 2048), counts, 2048) == packing.lower_bound(counts, 2048) == 1012
    assert packing.complete_bins({}, 2048) == []


TEXTS = [None, "", " ", "Hello, World!  it's\n\tÉtat x\x1cy don't 12345 ́a", "<|endoftext|> a", "word " * 5000, " a　b ΑΣ Σ", "日本語 text", "ÉTAT! it's!! İx. q's, A'LL. don't'. a.b, x\u0301, \u0301. 'S 5.5, ß.|| #a #"]


def test_pack(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "x", 0), (1, "", 0)], "doc_id long, text string, length int")
    got = packing.pack(docs).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in enumerate(TEXTS):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        if i == 1:
            mine = mine[:1]
        assert [r.start for r in mine] == list(range(0, len(ids), 2048))
        for r in mine:
            cut = ids[r.start : r.start + 2048]
            assert r.length == len(cut) and r.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack(docs.limit(0)).count() == 0

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_packing import check_plan, optimum

from caselode.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def histogram(lengths):
    values, n = np.unique(lengths, return_counts=True)
    return dict(zip(values.tolist(), n.tolist(), strict=True))


@pytest.mark.parametrize("alphabet", ["İIıŠšÀéßÿµªºΣςσA aZb.!?'ş̧́,|#5½ \n\t ǅﬁſK", "".join(map(chr, range(0x20, 0x250))), "aB. ̇'sé!"])
def test_ids_of_any_letters_and_marks(alphabet):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 16))) for _ in range(20_000)]
    texts += ["TARİHİ.", "İ!", "DENİZLİ, x", "ẋ.", "É!́"]
    plain = packing._tokenizer(PATH)
    got = packing.WordIds(PATH)(pa.array(texts))
    want = plain.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, a, e in zip(texts, got, want, strict=True) if a.tolist() != e.ids] == []


def test_blocks_and_full_tables_change_nothing():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["Aé.", "b", "cc,", "1x", "\n"]) for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    a, b = packing.WordIds(PATH)(pa.array(texts)), packing.WordIds(PATH, most=3, block=10)(pa.array(texts))
    assert all(x.tolist() == y.tolist() for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("seed", range(20))
def test_many_short_pieces_are_optimal(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(4, 20) for _ in range(12)]
    counts = {s: items.count(s) for s in set(items)}
    assert check_plan(packing.complete_bins(counts, 40), counts, 40) == optimum(items, 40)


def test_more_than_eight_pieces_a_bin():
    counts = {s: 3 for s in range(131, 190)}
    assert check_plan(packing.complete_bins(counts, 2048), counts, 2048) == 14
    counts = {s: 50 for s in range(10, 90)}
    assert check_plan(packing.complete_bins(counts, 2048), counts, 2048) == packing.lower_bound(counts, 2048)


@pytest.mark.parametrize("seed", range(3))
def test_hard_histograms_beat_best_fit(seed):
    counts = histogram(np.random.default_rng(seed).integers(300, 1101, 600))
    start = time.time()
    made = check_plan(packing.complete_bins(counts, 2048), counts, 2048)
    assert made <= sum(n for _, n in packing.best_fit(counts, 2048)) and made <= packing.lower_bound(counts, 2048) + 5
    assert time.time() - start < 60


def test_fillings_are_complete_and_undominated():
    counts = {2: 2, 3: 1, 5: 2, 7: 1}
    fill = packing.Fillings(counts, 10)
    every = {t: set(fill.of(t)) for t in fill.totals(0)}
    brute = {}
    for a in range(3):
        for b in range(2):
            for c in range(3):
                for d in range(2):
                    if (t := 2 * a + 3 * b + 5 * c + 7 * d) <= 10:
                        brute.setdefault(t, set()).add((7,) * d + (5,) * c + (3,) * b + (2,) * a)
    assert every == brute
    assert {x for t in every.values() for x in t if not fill.dominated(x)} == {(5, 5), (7, 3)}


def test_repeated_ids_and_long_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "word " * 60_000)], "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got) == 2 * 3 + 60_001 and len({(r.sequence_id, r.offset) for r in got}) == len(got)


def ends_soon(counts):
    start = time.time()
    made = check_plan(packing.complete_bins(counts, 2048), counts, 2048)
    assert time.time() - start < 5  # about one second alone
    assert made <= sum(n for _, n in packing.best_fit(counts, 2048))
    return made


@pytest.mark.parametrize("factor", range(2, 17))
def test_lengths_with_a_common_factor_end(factor):
    rng = np.random.default_rng(factor)
    for top in (600, 2000):
        counts = histogram(factor * rng.integers(1, top // factor + 1, 2500))
        ends_soon(counts)
        ends_soon(counts | {1: 3})


def test_histograms_that_had_no_end():
    rng = np.random.default_rng(0)
    for counts in (histogram(3 * rng.integers(1, 101, 3000)), histogram(10 * rng.integers(1, 61, 2000))):
        room = 2048 // min(counts) * min(counts)  # no bin holds more than the largest multiple
        assert ends_soon(counts) == -(-sum(s * n for s, n in counts.items()) // room)


def test_pruned_fillings_lose_no_undominated_one():
    rnd = random.Random(5)
    for _ in range(200):
        counts = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(5)}
        fill = packing.Fillings(counts, rnd.randint(5, 30))
        every = {x for t in fill.totals(0) for x in fill.of(t)}
        pruned = {x for t in fill.totals(0) for x in fill.of(t, every=False)}
        assert {x for x in every if not fill.dominated(x)} <= pruned <= every
        assert {x for x in every if not fill.dominated(x)} == set(fill.undominated(0))


def test_effort_bounds_all_work():
    counts = {s: 2 for s in range(1, 400)}
    fill = packing.Fillings(counts, 2000, packing.Effort(500))
    assert sum(1 for _ in fill.undominated(0)) <= 500 and fill.effort.left <= 0

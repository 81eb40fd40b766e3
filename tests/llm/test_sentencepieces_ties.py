import random
import string
import time
from array import array

import public_tokenizers
import pyarrow as pa
import pytest

from caselode.llm.sentencepieces import SPACE, Pieces, segment


@pytest.fixture(scope="module")
def pieces():
    return Pieces(public_tokenizers.path("piece_bpe_32k.model"), 5)


@pytest.mark.parametrize("mark", [*string.punctuation, "a", "1", " ", "\n"])
def test_long_runs_of_one_mark(pieces, mark):
    text = "a " + mark * 10_000 + " b"
    start = time.time()
    top = pieces.encode_all(text)
    assert time.time() - start < 5 and (len(top) == 5 or mark in "1\n")  # no piece holds two digits or two line ends
    assert all(pieces.decode(ids) == text for _, ids in top) and len({ids for _, ids in top}) == len(top)
    assert [s for s, _ in top] == sorted((s for s, _ in top), reverse=True)


def test_many_words_at_once_are_as_one_by_one(pieces):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abeéñß.,-\n1xth▁ 日İ\t") for _ in range(rnd.randint(1, 45))) for _ in range(3000)]
    words = [w.replace(" ", SPACE) for w in words]
    ok, score, loss, count = pieces.lattice.best(words)
    found = {}
    for who, ids in pieces.lattice.found:
        at = 0
        for i in who.tolist():
            found[i] = ids[at : at + count[i]].tobytes()
            at += count[i]
    assert ok.sum() > 500
    for i in ok.nonzero()[0].tolist():
        assert (score[i], found[i], loss[i]) == pieces.viterbi(words[i])


def test_blocks_and_full_tables_change_nothing(pieces):
    rnd = random.Random(6)
    parts = ["the", "of", "a\n\nb", "--", "日本", "ñé", "", "x" * 60]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    small = Pieces(public_tokenizers.path("piece_bpe_32k.model"), 5, most=10, block=50)
    assert list(pieces.encode_many(pa.array(texts))) == list(small.encode_many(pa.array(texts)))


def test_ids_of_each_segmentation_decode_to_the_text(spark):
    rows = [(1, "---- and more"), (2, " x  y\n日本"), (3, "\n\n"), (None, "z")]
    plain = Pieces(public_tokenizers.path("piece_bpe_32k.model"), 5)
    for r in segment(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True).collect():
        assert r.round_trip
        for n in r.n_best:
            assert plain.decode(array("I", n.ids).tobytes()) == dict(rows)[r.doc_id]

import public_tokenizers
import pytest
from test_sentencepieces import all_segmentations

from caselode.llm.sentencepieces import SPACE, Pieces, decode, segment


@pytest.mark.parametrize("n_best", [1, 2, 5])
@pytest.mark.parametrize("text", ["", "a b", "hello you", "  two", "aaaa", "ñé z.", "it's\nok"])
def test_ids_of_all_segmentations(text, n_best):
    pieces = Pieces(public_tokenizers.path("piece_bpe_32k.model"), n_best)
    s = SPACE + text.replace(" ", SPACE) if text else ""
    every = sorted(all_segmentations(pieces, s), reverse=True)
    got = [(score, tuple(memoryview(ids).cast("I"))) for score, ids in pieces.encode_all(text)]
    assert [g[0] for g in got] == [e[0] for e in every[:n_best]]
    assert len(set(got)) == len(got) and set(got) <= set(every)


def test_decode(spark):
    rows = [(1, "Some words here."), (2, ""), (3, " x  y\n日本"), (None, "z")]
    got = segment(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True)
    for i in range(2):
        ids = got.selectExpr("doc_id", f"get(n_best, {i}).ids as ids")
        want = rows if i == 0 else [(d, t or None) for d, t in rows]
        assert sorted(map(tuple, decode(ids).collect()), key=repr) == sorted(want, key=repr)

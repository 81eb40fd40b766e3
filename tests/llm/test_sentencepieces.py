import zlib
from array import array

import public_tokenizers
import pytest

from caselode.llm.sentencepieces import SPACE, Pieces, segment


@pytest.fixture(scope="module")
def pieces():
    return Pieces(public_tokenizers.path("piece_bpe_32k.model"), 5)


def all_segmentations(pieces, s):
    if not s:
        return [(0.0, ())]
    out = []
    for j in range(1, len(s) + 1):
        e = pieces.table.get(s[:j])
        head = ((e[0],), e[1]) if e else pieces._char(s[0]) if j == 1 else None
        if head:
            out += [(head[1] + score, head[0] + ids) for score, ids in all_segmentations(pieces, s[j:])]
    return out


@pytest.mark.parametrize("text", ["the", "a b", "hello you", "  two", "x  ", "aaaa", "ñé z.", "日a", "it's\nok", ".,!", " ", "\x00\t", "éx"])
def test_n_best_against_enumeration(pieces, text):
    s = SPACE + text.replace(" ", SPACE)
    every = sorted(all_segmentations(pieces, s), reverse=True)
    ids, top = pieces.encode(text)
    assert [t[0] for t in top] == [x[0] for x in every[:5]]
    assert [t[0] for t in pieces.n_best_of(s)] == [x[0] for x in every[:5]]
    assert (top[0][0], tuple(array("I", ids))) in every
    assert pieces.viterbi(s)[0] == every[0][0]
    assert len(every) == 1 or pieces.viterbi(s)[2] == every[0][0] - every[1][0]
    assert pieces.decode(ids) == text
    assert {n for s_, n in top} <= {len(x[1]) for x in every}


def test_segment(spark):
    docs = spark.createDataFrame([(1, "Some words here.", 1), (2, None, 2), (3, "", 3), (None, "x", 4), (1, "Some words here.", 5), (4, "long word " + "ab" * 20_000, 6)], "doc_id long, text string, ids int")
    got = segment(docs, with_ids=True).collect()
    assert len(got) == 6 and all(r.round_trip for r in got)
    for r in got:
        assert r.n_tokens == len(r.ids) == r.n_best[0].n_tokens and r.ids_crc32 == zlib.crc32(array("I", r.ids).tobytes())
        assert [s.score for s in r.n_best] == sorted((s.score for s in r.n_best), reverse=True)
    assert [len(r.n_best) for r in got if r.doc_id in (2, 3)] == [1, 1]
    assert segment(docs.limit(0)).count() == 0


def test_fixture_round_trip(spark):
    got = segment(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert got.where("not round_trip").count() == 0 and got.count() == 200

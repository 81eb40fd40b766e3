"""The automaton against plain searches."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselode.operators import lexicon as L
from caselode.operators import matching as M
from caselode.operators import vendors as V

LETTERS = "ab 1.é"


def made(seed, n_alias=60, n_text=60):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice(LETTERS) for _ in range(n))
    aliases = [(f"T{rnd.randint(0, 9)}", word(rnd.randint(1, 10))) for _ in range(n_alias)]
    texts = [word(rnd.randint(0, 80)).upper() for _ in range(n_text)] + [None, "", "a" * 3000]
    return aliases, texts


def plain_hits(aliases, text, least=3):
    low, out = (text or "").lower(), {}
    ordered = sorted(((a.strip().lower(), t, i) for i, (t, a) in enumerate(aliases)), key=lambda x: (-len(x[0]), x[2]))
    for a, t, _ in ordered:
        if len(a) >= least and t not in out:
            loose = " " in a or len(a) >= 8
            if a in low if loose else re.search(rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])", low):
                out[t] = a
    return sorted(out.items())


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("part", [20, 1 << 20])
def test_hits_equal_one_search_an_alias(spark, monkeypatch, seed, part):
    monkeypatch.setattr(L, "PART_BYTES", part)
    aliases, texts = made(seed)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    table = spark.createDataFrame([(t, "x", "th", a, i) for i, (t, a) in enumerate(aliases)], "technique string, title string, theme string, alias string, nth int")
    lexicon = L.Lexicon.of_table(table.withColumn("low", F.lower(F.trim("alias"))), group="technique", alias="alias", nth="nth", payload=["technique", "low"])
    assert (lexicon.n_parts > 1) == (part == 20)
    want = {i: plain_hits(aliases, t) for i, t in enumerate(texts)}
    got = rows.select("i", L.hits(rows, F.lower("content"), lexicon).alias("h")).collect()
    assert {r.i: [(h.technique, h.low) for h in r.h] for r in got} == want
    large = L.scan_large(rows.withColumn("low_text", F.lower("content")), ["i"], "low_text", lexicon)
    assert sorted((r.i, r.technique, r.low) for r in large.collect()) == sorted((i, *h) for i, hs in want.items() for h in hs)
    listed = [(f"T{k}", "x", "th", [a for t, a in aliases if t == f"T{k}"]) for k in range(10)]
    assert {r.i: [h.technique for h in r.hits] for r in M.technique_hits(rows, listed).collect()} == {i: [t for t, _ in h] for i, h in want.items()}


@pytest.mark.parametrize("seed", range(3))
def test_mentions_equal_one_alternation(spark, seed):
    aliases, texts = made(seed + 10)
    rows = spark.createDataFrame([(f"l{i}", t, True) for i, t in enumerate(texts)], "link string, text string, verdict boolean")
    table = spark.createDataFrame([("c", t, a) for t, a in aliases], "category string, vendor string, alias string")
    homes = {}
    for t, a in aliases:
        if plain := " ".join(a.lower().split()):
            homes.setdefault(plain, set()).add(t)
    body = "|".join(r"\s+".join(map(re.escape, a.split())) for a in sorted(homes, key=lambda a: (-len(a), a)))
    pattern = re.compile(rf"(?<![a-z0-9])(?:{body})(?![a-z0-9])")
    want = {(t, f"l{i}") for i, text in enumerate(texts) for m in pattern.finditer((text or "").lower()) for t in homes[" ".join(m[0].split())]}
    assert {(r.vendor, r.link) for r in V.mentions(rows, table).collect()} == want


def test_too_large_a_lexicon_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_BYTES", 10)
    rows = spark.createDataFrame([("abc",)], "content string")
    lexicon = L.Lexicon.of_list([("g", "abc" * 20, "p")], ["p"])
    with pytest.raises(ValueError, match="scan_large"):
        L.hits(rows, F.col("content"), lexicon)
    assert L.scan_large(rows.select("content", F.repeat("content", F.lit(20)).alias("low")), ["content"], "low", lexicon).first().p == "p"


def test_empty_lexicon_and_plan_size(spark):
    rows = spark.createDataFrame([("abc",)], "content string")
    assert M.technique_hits(rows, []).first().hits == []
    plan = lambda n: len(M.technique_hits(rows, [("T", "t", "h", [f"alias{i}" for i in range(n)])])._jdf.queryExecution().toString())
    assert plan(5000) < plan(5) + 50


def test_topics(spark):
    rows = spark.createDataFrame([("Joint use", "s", "nothing"), ("t", None, "from"), (None, None, None)], "title string, summary string, content string")
    taxonomy = [("A", "Joint Use", "x", ["from"]), ("B", "no", "x", ["t"])]
    assert [r.topics for r in M.topics_of(rows, taxonomy).collect()] == [["A"], ["A"], []]


def test_a_batch_holds_places_and_not_rows(spark):
    """The hits of a batch are numbers in Python, however many they are."""
    entries = [(f"T{i}", f"alias {i:03d}", f"T{i}") for i in range(100)]
    find = L._matcher(spark.range(1), L.Lexicon.of_list(entries, ["technique"]), 0, 8).func
    texts = pa.array([" ".join(e[1] for e in entries), None, "alias 007"] * 700)
    tracemalloc.start()
    got = next(find(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2100 and got[3].as_py() == [{"technique": e[2]} for e in entries]
    assert got[1].as_py() == [] and got[2].as_py() == [{"technique": "T7"}]
    assert peak < 8 << 20

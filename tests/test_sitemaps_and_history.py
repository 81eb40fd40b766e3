"""Sitemap walks against a queue, histories rewritten in place, and rows kept at their best."""

import random

import pytest

from caselode.operators import history as H
from caselode.sources import sitemaps as S


def plain_walk(children, root, preferred=(), skipped=(), most=10**9):
    queue, seen = [root], []
    while queue and len(seen) < most:
        at = queue.pop(0)
        if at in seen:
            continue
        seen.append(at)
        first, rest = [], []
        for c in dict.fromkeys(children.get(at, [])):
            if c in seen or c in queue or c == at or any(x in c for x in skipped):
                continue
            (first if any(x in c for x in preferred) else rest).append(c)
        queue[0:0] = first + rest
    return seen


@pytest.mark.parametrize("seed", range(4))
def test_walks_with_cycles(spark, seed):
    rnd = random.Random(seed)
    names = [f"s{i}{rnd.choice(['', '', '-news', '-video'])}" for i in range(25)]
    children = {n: [rnd.choice(names) for _ in range(rnd.randint(0, 3))] for n in names}
    rows = [(p, i, c) for p, cs in children.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "parent string, nth int, child string")
    for options in ({}, {"preferred": ["NEWS"], "skipped": ["video"]}, {"most": 4}):
        want = plain_walk(children, names[0], **{k: [x.lower() for x in v] if isinstance(v, list) else v for k, v in options.items()})
        assert [r.sitemap for r in S.visit_order(df, names[0], **options).orderBy("rank").collect()] == want


@pytest.mark.parametrize("steps", [0, 1000])
def test_deep_and_wide_walks_end(spark, monkeypatch, steps):
    """What a bounded walk reads is what it opens, however deep the sitemaps go on; both ways give one order."""
    monkeypatch.setattr(S, "STEPS", steps)
    deep = 10**6 if steps else 10
    wide = [("r", i, f"w{i % 7}") for i in range(20)] + [("w1", 0, "d0"), ("w1", 1, "w5"), ("w1", 2, "w9"), ("d0", 0, "r"), ("d0", 1, "d0")]
    chain = spark.range(deep).selectExpr("concat('d', id) AS parent", "2 AS nth", "concat('d', id + 1) AS child")
    df = spark.createDataFrame(wide, "parent string, nth int, child string").unionByName(chain)
    children = {}
    for p, _, c in wide:
        children.setdefault(p, []).append(c)
    for i in range(10):
        children.setdefault(f"d{i}", []).append(f"d{i + 1}")
    got = [r.sitemap for r in S.visit_order(df, "r", most=8).orderBy("rank").collect()]
    assert got == plain_walk(children, "r", most=8) == ["r", "w0", "w1", "d0", "d1", "d2", "d3", "d4"]


def test_pages_of_a_walk(spark):
    entries = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b"), ("a", 0, "r"), ("b", 0, "gone"), ("r", 2, None)], "parent string, nth int, child string")
    pages = spark.createDataFrame([("b", 0, "http://x/En/1"), ("a", 1, "http://x/en/2?q"), ("a", 0, "http://x/de/en"), ("z", 0, "http://x/en/9"), ("a", 2, None)], "sitemap string, nth int, url string")
    got = S.walk(entries, pages, "r", hints=["/en/"]).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(1, "a", "http://x/en/2?q"), (2, "b", "http://x/En/1")]
    assert S.walk(entries, pages, "r", max_sitemaps=2).count() == 2 and S.walk(entries, pages, "r", max_urls=1).count() == 1
    assert S.walk(entries.limit(0), pages, "none").count() == 0


NESTED = "link string, body string, history array<struct<model:string,methods:array<struct<quote:string,verbatim:boolean,note:int>>>>"


def test_only_changed_rows_are_written(spark, tmp_path):
    rows = [
        ("same", "He said “two  words”", [("m", [('"two words"', True, 1), (" ", None, 2)])]),
        ("new", "He said it", [("m", [("said", None, 1)]), ("n", None), ("o", [("never", None, 2)])]),
        ("lost", None, [("m", [("x", True, 3)])]),
        ("none", "text", None),
    ]
    df = spark.createDataFrame(rows, NESTED)
    got = {r.link: r for r in H.stamp_history(df).collect()}
    assert {k for k, r in got.items() if r.changed} == {"new", "lost"}
    assert got["new"].history[0].methods[0].verbatim is True and got["new"].history[2].methods[0].verbatim is False
    assert got["new"].history[1].methods is None and got["new"].history[0].methods[0].note == 1 and got["none"].history is None
    assert H.rewrite_changed(df, f"file://{tmp_path}/out") == 2
    assert {r.link for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {"new", "lost"}
    assert H.rewrite_changed(df.limit(0), f"file://{tmp_path}/none") == 0


def test_poorer_rows_do_not_replace_richer_ones(spark):
    kind = "link string, text string, rich double"
    old = spark.createDataFrame([("a", "old", 3.0), ("b", "old", 1.0), ("c", "old", 2.0), ("d", "old", None), ("a", "older", 1.0), (None, "x", 9.0), ("gone", "x", 9.0)], kind)
    now = spark.createDataFrame([("a", "new", 1.0), ("b", "new", 1.0), ("c", "new", None), ("d", "new", None), (None, "y", 0.0), ("e", "new", 0.0)], kind)
    got = sorted(((r.link, r.text, r.restored) for r in H.keep_best(old, now, "link", "rich").collect()), key=repr)
    assert got == sorted([("a", "old", True), ("b", "new", False), ("c", "old", True), ("d", "new", False), (None, "y", False), ("e", "new", False)], key=repr)


def test_shared_files(spark, tmp_path, monkeypatch):
    from caselode.sources import shared

    monkeypatch.setattr(shared, "_handed", [])
    path = shared.fresh_path(spark, "x")
    assert shared.create_text(spark, f"{path}/a.txt", "é") and not shared.create_text(spark, f"{path}/a.txt", "b")
    assert shared.read_text(spark, f"{path}/a.txt") == "é" and shared.names(spark, path) == ["a.txt"]
    assert shared.clean_up(spark) == 1 and not shared.exists(spark, path) and shared.names(spark, path) == []

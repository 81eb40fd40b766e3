"""Landed pages with lost and repeated cursors; the sweep across restarts and throttling."""

import datetime as dt
import json

import pytest

from caselode.sources import paged
from caselode.streaming import sweep as W


def put(root, query, cursor, body):
    at = root / paged.file_of(query, cursor)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(body))


def hit(i, filed="2024-01-05"):
    return {"link": f"l{i}", "title": f"t{i}", "filed": filed, "body": None}


def links(df):
    return [(r.query, r.page, r.link) for r in df.orderBy("query", "page", "place").collect()]


def test_cursors(spark, tmp_path):
    q = "a/b c?"
    put(tmp_path, q, "first", {"results": [hit(1), hit(2), {"title": "no link"}, "junk"], "next": "x/1"})
    put(tmp_path, q, "x/1", {"results": [hit(2), hit(3)], "next": "x2"})
    put(tmp_path, q, "x2", {"results": [hit(4)], "next": None})
    put(tmp_path, "lost", "first", {"results": [hit(5)], "next": "gone"})
    put(tmp_path, "round", "first", {"results": [hit(6)], "next": "again"})
    put(tmp_path, "round", "again", {"results": [hit(7), hit(1)], "next": "first"})
    put(tmp_path, "nobody", "later", {"results": [hit(8)], "next": None})
    put(tmp_path, "empty", "first", {"results": None, "next": 7})
    read = lambda **o: paged.read_pages(spark, f"file://{tmp_path}", **o)
    want = [(q, 1, "l1"), (q, 1, "l2"), (q, 2, "l2"), (q, 2, "l3"), (q, 3, "l4"), ("lost", 1, "l5"), ("round", 1, "l6"), ("round", 2, "l7"), ("round", 2, "l1")]
    assert links(read()) == want
    assert links(read(max_pages=1)) == [w for w in want if w[1] == 1]
    assert links(paged.each_link_once(read())) == [w for w in want if w not in ((q, 2, "l2"), ("round", 2, "l1"))]
    assert read().rdd.getNumPartitions() == 7  # one a page
    assert links(paged.read_pages(spark, f"file://{tmp_path}/none")) == []


def test_streams_end_at_a_page_without_items(spark, tmp_path):
    put(tmp_path, "s", "first", {"items": [hit(1)], "continuation": "c1"})
    put(tmp_path, "s", "c1", {"items": [], "continuation": "c2"})
    put(tmp_path, "s", "c2", {"items": [hit(2)]})
    assert links(paged.read_pages(spark, f"file://{tmp_path}", kind="stream")) == [("s", 1, "l1")]


def test_bounds_reach_the_source(spark, tmp_path):
    put(tmp_path, "a", "first", {"results": [hit(i, f"2024-01-0{i}") for i in range(1, 6)] + [hit(9, None)], "next": None})
    put(tmp_path, "b", "first", {"results": [hit(7, "2024-01-03")], "next": None})
    read = paged.read_pages(spark, f"file://{tmp_path}").where("filed >= '2024-01-02' and filed <= '2024-01-03'")
    assert links(read) == [("a", 1, "l2"), ("a", 1, "l3"), ("b", 1, "l7")]
    only = read.where("query = 'a'")
    assert links(only) == [("a", 1, "l2"), ("a", 1, "l3")] and only.rdd.getNumPartitions() == 1
    assert links(paged.read_pages(spark, f"file://{tmp_path}", filed_after="2024-01-05")) == [("a", 1, "l5")]


def test_what_is_landed_is_read(spark, tmp_path):
    rows = [(f"q{i % 2}", i // 4, f"l{i:02}", "t", None, "b") for i in range(20)]
    paged.land(spark.createDataFrame(rows, "query string, page int, link string, title string, filed string, body string"), f"file://{tmp_path}")
    got = links(paged.read_pages(spark, f"file://{tmp_path}", max_pages=4))
    assert got == sorted((q, p + 1, link) for q, p, link, *_ in rows if p < 4)


def plain(queries, newest, floor, days, per):
    out, last, per = [], newest, per or len(queries)
    while last > floor:
        first = max(floor, last - dt.timedelta(days=days))
        for s in range(0, len(queries), per):
            out.append([(first, last, s // per, s + i, q) for i, q in enumerate(queries[s : s + per])])
        last = first
    return out


@pytest.mark.parametrize("per", [0, 2])
def test_sweep_across_restarts(spark, tmp_path, per):
    queries = W.gap_first(["a", "b", "c", "d", "e"], ["b", "a"])
    assert queries == ["c", "d", "e", "a", "b"]
    stop = tmp_path / "throttled"
    path, floor, newest = str(tmp_path / "s"), "2024-01-01", "2024-03-10"
    want = plain(queries, dt.date(2024, 3, 10), dt.date(2024, 1, 1), 30, per)
    made = lambda: W.sweep(spark, queries, newest, floor, days=30, per=per, throttled=str(stop))
    rows = lambda: sorted(map(tuple, spark.read.schema(W.SCHEMA).parquet(f"{path}/requests").collect()))
    for n in (1, 2):
        W.run_once(made(), path)  # each run starts the stream anew from its cursor
        assert rows() == sorted(r for b in want[:n] for r in b)
    stop.write_text("429")
    W.run_once(made(), path)
    assert rows() == sorted(r for b in want[:2] for r in b)
    stop.unlink()
    done = W.run_to_the_floor(made(), path)
    assert sorted(map(tuple, done.collect())) == sorted(r for b in want for r in b)
    W.run_once(made(), path)
    assert len(rows()) == sum(map(len, want))

"""Rules that have no SQL twin, against plain Python."""

import hashlib
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.operators import incremental as I
from caselode.operators import matching as M
from caselode.operators import records as R
from caselode.operators import search as S
from caselode.plans import reading as G
from caselode.sources import fixtures as X
from caselode.sources import parsing as P
from caselode.streaming import clocks as K
from caselode.streaming import events as E

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def plain_key(title, day):
    t = title.strip().lower()
    for _ in range(2):
        t = re.sub(r"\s*[|–—-]\s*[^|]+$", "", t).strip()
    t = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]+", " ", t)).strip()
    return hashlib.sha1(f"{t}|{day}".encode()).hexdigest()[:16]


@pytest.mark.parametrize("title", ["A Case:  Won! - The Daily | news.com", "Won—Daily", "won – x", "  ", "- a", "a|b|c|d", "Ünïcode - x", "co-op wins"])
def test_story_keys(spark, title):
    stamp = F.lit("2024-05-06 23:30:00").cast("timestamp")
    assert one(spark, T.story_key(F.col("t"), stamp), t=title) == plain_key(title, "2024-05-06")
    assert one(spark, T.story_key(F.col("t"), F.lit(None).cast("timestamp"), stamp), t=title) == plain_key(title, "2024-05-06")
    assert one(spark, T.story_key(F.col("t"), F.lit(None).cast("timestamp")), t=title) == plain_key(title, "undated")


def test_filing_keys(spark):
    want = hashlib.sha1(b"docket|d. mass.|1:24-cr-00001").hexdigest()[:16]
    assert one(spark, T.filing_story_key(F.col("c"), F.col("d")), c=" D.  Mass. ", d="1:24-CR-00001") == want


@pytest.mark.parametrize(("term", "want"), [("", True), ("a@b", True), ("Holly Hill Logistics", True), ("acme inc", True), ("incident report", False), ("Robert Dawson", True), ("usb Stick", False), ("3 Big Bags", True), ("one", False), ("group chat", True)])
def test_entity_terms(spark, term, want):
    assert one(spark, T.is_entity_term(F.col("t")), t=term) is want


def test_columns_are_computed_once(spark):
    plan = G.article_filters(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 30


def test_themes_and_topics(spark):
    rows = M.technique_hits(spark.createDataFrame([("t", "s", "from here"), ("joint use", "s", "nothing")], "title string, summary string, content string"), X.TAXONOMY)
    assert [r.title for r in rows.where(M.has_theme("MOTIVE")).collect()] == ["t"] and rows.where(M.has_theme(" ")).count() == 2
    assert [r.title for r in rows.where(M.has_topic("Joint use", ["ab"])).collect()] == ["joint use"]


def test_hybrid_scores(spark):
    rows = G.scored(spark, SF).where("row_ord < 40")
    query = "thing the license"
    got = {r.link: r.score for r in S.hybrid_top(rows, query, 40).collect()}
    find = lambda t: re.findall(r"[a-z0-9][a-z0-9+._-]{1,}", t.lower())
    asked = set(find(query))
    e = np.array(S.embed(query))
    for r in rows.collect():
        blob = f"{r.title} {r.summary} {r.content}"
        hit = asked & set(find(blob))
        if hit:
            keyword = min(1.0, len(hit) / len(asked) + 0.15 * bool(asked & set(find(r.title))) + 0.2 * any(t.startswith("cve") for t in hit))
        else:
            keyword = 0.4 if " ".join(sorted(asked)) in f"{r.title} {r.content}".lower() else 0.0
        v = np.zeros(256)
        for t in find(blob):
            h = hashlib.blake2b(t.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "little") % 256] += 1 if h[4] % 2 == 0 else -1
        semantic = max(0.0, (v @ e / (np.linalg.norm(v) or 1) + 1) / 2)
        assert got[r.link] == pytest.approx(0.55 * keyword + 0.35 * semantic + 0.1 * r.relevance_score, abs=1e-4)


def test_limiter_and_clusters_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = np.random.default_rng(0)
        events = [(int(rng.integers(0, 4)), i, int(rng.integers(0, 3000))) for i in range(200)]
        rows = spark.createDataFrame(events, "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
        got = {r.event_id: r.admitted for r in I.admitted(rows, "user_id", 3, 300).collect()}
        recent, want = {}, {}
        for u, i, s in sorted(events, key=lambda e: (e[0], e[2], e[1])):
            held = [x for x in recent.get(u, []) if s - x < 300]
            want[i] = len(held) < 3
            recent[u] = held + [s] * want[i]
        assert got == want
        vectors = [(i, int(i % 3), rng.normal(size=4).tolist()) for i in range(120)]
        found = {r.vec_id: r.cluster for r in I.leader_clusters(spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>"), 0.72, F.col("label")).collect()}
        sums = {}
        for i, b, x in sorted(vectors, key=lambda v: (v[1], v[0])):
            x, own = np.array(x) / np.linalg.norm(x), sums.setdefault(b, [])
            cos = [s @ x / np.linalg.norm(s) for s in own]
            at = max((c, k) for k, c in enumerate(cos))[1] if cos and max(cos) >= 0.72 else len(own)
            own[at:] = [own[at] + x, *own[at + 1 :]] if at < len(own) else [x]
            assert found[i] == at
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_streams_read_a_key_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        cycles = [(1, c, o) for c, o in enumerate(["failed", "failed", "skipped", "failed", "ok", "failed", "failed"])][::-1]
        spark.createDataFrame(cycles, "lane long, cycle long, outcome string").coalesce(1).write.parquet(str(tmp_path / "c"))
        stream = spark.readStream.schema("lane long, cycle long, outcome string").parquet(str(tmp_path / "c"))
        got = E.drain(E.failure_counts(stream), str(tmp_path / "co")).orderBy("cycle").collect()
        assert [r.failures for r in got] == [1, 2, 2, 3, 0, 1, 2]
        asks = [("a", t, g, e) for t, g, e in [(0, True, False), (5, True, False), (100, False, False), (101, True, False), (150, True, False), (205, True, True), (400, True, False)]]
        kind = "link string, t long, nth long, genuine boolean, ended boolean"
        asks = [(link, 1000 + t, 0, g, e) for link, t, g, e in asks]  # a stamp of 0 would be late: no watermark is 0
        spark.createDataFrame(asks[::-1], kind).coalesce(1).write.parquet(str(tmp_path / "a"))
        got = E.drain(K.due_checks(spark.readStream.schema(kind).parquet(str(tmp_path / "a")), 100, 10_000), str(tmp_path / "ao")).orderBy("t").collect()
        assert [r.due for r in got] == [True, False, True, True, False, True, False]
        rows = [("x", 1), ("x", 2), ("y", 3)]
        spark.createDataFrame(rows, "link string, s long").select("link", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "f"))
        seen = E.drain(E.first_seen(spark.readStream.schema("link string, ts timestamp").parquet(str(tmp_path / "f")), "link"), str(tmp_path / "fo"))
        assert sorted(r.link for r in seen.collect()) == ["x", "y"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stores(spark):
    schema = "link string, title string, summary string, content string, n int"
    store = spark.createDataFrame([("a", "t", "s", "body", 1), ("b", "t", "s", "", 2), ("c", "t", "s", "x", 3)], schema)
    new = spark.createDataFrame([("a", "t", "s", "other", 1), ("b", "t", "s", "now", 2), ("d", None, "s", "new", 3), ("c", None, None, "y", 9)], schema)
    got = {r.link: (r.action, r.content, r.n) for r in I.merge_refresh(store, new, derived=("n",)).collect()}
    assert got == {"a": ("kept", "body", 1), "b": ("replaced", "now", None), "c": ("replaced", "y", None), "d": ("inserted", "new", None)}
    assert {r.action for r in I.merge_refresh(store, new.where("link = 'a'"), force=True).collect()} == {"replaced", "kept"}
    twice = spark.createDataFrame([("z", "late", "", "", 2), ("z", "early", "", "", 1), ("a", "", "", "", 0)], schema)
    assert [(r.link, r.title) for r in I.append_new(store, twice, "link", ["n"]).collect()] == [("z", "early")]


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed><entry><title>One</title><link rel="self" href="http://x/self"/><link href="http://x/1"/><summary>s</summary><updated>2024-05-01T00:00:00Z</updated></entry>'
        '<entry><title>Two</title><link href="http://x/1"/></entry><entry><title>Three</title><link href="ftp://x/3"/></entry></feed>'
    )
    got = P.feed_items(spark, str(tmp_path / "a.xml"), "entry").collect()
    assert [(r.link, r.published) for r in got if r.title == "One"] in ([("http://x/1", datetime(2024, 5, 1))], []) and len(got) == 1
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>R</title><link> https://x/r </link><pubDate>Wed, 01 May 2024 10:00:00 +0000</pubDate></item><item><title></title><link>https://x/s</link></item></channel></rss>")
    assert [(r.title, r.link, r.published) for r in P.feed_items(spark, str(tmp_path / "r.xml")).collect()] == [("R", "https://x/r", datetime(2024, 5, 1, 10))]


def test_page_dates_and_pdf_links(spark):
    html = '<meta name="date" content="soon"><meta property="og:published_time" content=" 2024-05-02 "><meta name="twitter:title" content="T"><time datetime="2020-01-01"></time>'
    html += '<meta name="citation_pdf_url" content="/c.pdf"><link type="application/pdf" href="t"><a href="b.PDF?x=1">b</a><a href="/c.pdf">c</a><a href="d.html">d</a>'
    rows = spark.createDataFrame([("https://h/p/q", html), ("https://h/", '<meta name="date" content="no"><time datetime="Wed, 01 May 2024 10:00:00 +0000">')], "url string, html string")
    got = [r.p for r in rows.select(P.page_parts("html").alias("p")).collect()]
    assert (got[0].title, got[0].published) == ("T", "2024-05-02") and got[1].published.startswith("Wed")
    spark.udtf.register("pdf_links", P.PdfLinks)
    rows.createOrReplaceTempView("pdf_pages")
    found = spark.sql("select nth, l.url from pdf_pages, lateral pdf_links(pdf_pages.url, pdf_pages.html) l").collect()
    assert [r.url for r in sorted(found, key=lambda r: r.nth)] == ["https://h/c.pdf", "https://h/p/t", "https://h/p/b.PDF?x=1"]


def test_labels_and_gates(spark):
    for model, want in [("Org/some-model-32B-20240131", "Some Model 32B"), ("known", "Label"), (" ", None), ("a_b", "A B")]:
        assert one(spark, R.model_label(F.col("m"), {"known": "Label"}), m=model) == want
    rows = spark.createDataFrame(
        [("filings", "x" * 1500, ["u"], [], 1), ("filings", "x", ["u"], ["h"], 2), ("news", "x", ["u"], [], 3), ("social", "", ["u"], [], 4), ("news", "", [], ["h"], 5)],
        "channel string, content string, use_cases array<string>, hits array<string>, n int",
    )
    passed = lambda framed, needed: [r.n for r in rows.where(R.spend_gate(F.lit(False), F.lit(framed), body_needed=needed)).collect()]
    assert passed(False, True) == [1, 4] and passed(True, True) == [1, 4, 5] and passed(False, False) == [1, 2, 4]


def test_passages_in_any_place(spark):
    docs = spark.createDataFrame([(1, "xxone two three fouryy  and more"), (2, "One “two” three"), (3, None), (4, "one two  three four")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "one two three four"), (2, 'one "two" three'), (3, "two three"), (4, None), (5, "three fou"), (6, "ore"), (7, " ")], "item_id long, text string")
    assert sorted(map(tuple, M.quotes_found(docs, quotes).collect())) == [(1, 1), (1, 3), (1, 5), (1, 6), (2, 2), (4, 1), (4, 3), (4, 5)]
    assert M.quotes_found(docs.limit(0), quotes).count() == 0


def test_stream_entries(spark):
    import json

    from caselode.sources import payloads

    items = [
        {"title": " A ", "originId": "tag:1", "alternate": [{"href": "http://x/1"}], "summary": {"content": "<p>one  two</p>"}, "categories": [{"label": "c"}], "keywords": ["k", "c", " "], "published": 1000},
        {"title": "", "canonicalUrl": "http://x/2"},
        {"title": "no link", "originId": "tag:2"},
        {"title": "bare", "canonicalUrl": "https://x/3", "crawled": 2500, "origin": {"title": "O"}},
    ]
    rows = spark.createDataFrame([(json.dumps({"items": items}),), ("no json",)], "p string")
    got = rows.select(payloads.stream_entries(F.col("p"), "feed/http://x y").alias("e")).collect()
    assert [(e.title, e.link, e.summary, e.source_id, e.source_name) for e in got[0].e] == [
        ("A", "http://x/1", "one two\n\nLabels: c; k", "reader-feed-http-x-y", "Reader"),
        ("bare", "https://x/3", None, "reader-feed-http-x-y", "O"),
    ]
    assert got[0].e[0].published == datetime(1970, 1, 1, 0, 0, 1) and not got[1].e


def test_packages_states_and_pages(spark, tmp_path):
    rows = spark.range(5).select("id", F.lit("x").alias("t"))
    assert R.export_package(rows, rows.limit(2), str(tmp_path / "p")) == {"rows": 5, "candidates": 2}
    assert spark.read.json(str(tmp_path / "p/rows")).count() == 5 and spark.read.json(str(tmp_path / "p/manifest")).first().rows == 5
    for text, want in [('{"a": "1"}', {"a": "1"}), ("no", {}), ("", {}), ("[1]", {})]:
        assert one(spark, R.state_of(F.col("s")), s=text) == want
    text = "body\n=== UPDATES as of 2023-01-01 ===\n- old"
    assert one(spark, R.docket_updates(F.col("b"), F.col("e"), F.lit("2024-01-01")), b=text, e=["new", "x" * 400]) == "body\n=== UPDATES as of 2024-01-01 ===\n- new\n- " + "x" * 300
    assert one(spark, R.docket_updates(F.col("b"), F.col("e"), F.lit("2024-01-01")), b=text, e=[]) == "body"


def test_embedder_looks_words_up_one_by_one():
    """A text costs its own words, not the vocabulary that was seen before it."""

    class Held(dict):
        def keys(self):
            raise AssertionError("goes over the whole vocabulary")

    embedder = S.Embedder(most=6)
    embedder.known = Held()
    texts = ["one two two", "three four five six", "", None, "one seven", "eight nine ten eleven twelve thirteen"]
    assert [embedder([t])[0].tolist() for t in texts] == [S.embed(t) for t in texts]
    assert embedder.known and len(embedder.known) <= 6

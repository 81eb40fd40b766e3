"""Small cases with known answers for what the SQL twins don't cover."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselode.functions import text as X
from caselode.operators import incremental as I
from caselode.operators import ledger as L
from caselode.operators import matching as M
from caselode.operators import search as S
from caselode.operators import vendors as V
from caselode.sources import fixtures
from caselode.sources import parsing as P
from caselode.streaming import events as E
from caselode.streaming import store

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_alias_rule(spark):
    assert one(spark, X.has_alias(F.col("t"), "usb"), t="a usb stick")
    assert not one(spark, X.has_alias(F.col("t"), "usb"), t="usb2 susb")
    assert one(spark, X.has_alias(F.col("t"), "exfiltra"), t="exfiltrated")


@pytest.mark.parametrize(("quote", "want"), [("“Two  words”", True), ("two", True), ("three", False), (" ", None), (None, None)])
def test_quote_stamp(spark, quote, want):
    df = spark.createDataFrame([(quote, 'He said "two words".')], "q string, b string")
    assert df.select(X.quote_is_verbatim(F.col("q"), F.col("b"))).first()[0] is want


def test_titles_and_keys(spark):
    assert one(spark, X.normalise_title(F.col("t")), t="A Case:  Won! - The Daily | news.com") == "a case won"
    assert one(spark, X.head_tail(F.col("t"), 12, "~"), t="abcdefghijklmnop") == "abcdefghij~op"


def test_longest_alias_wins(spark):
    rows = spark.createDataFrame([("the mit license text",)], "content string")
    lexicon = [("T1", "One", "x", ["mit", "mit license"]), ("T2", "Two", "x", ["absent"])]
    assert [h.alias for h in M.technique_hits(rows, lexicon).first().hits] == ["mit license"]


def test_posture_caps_but_never_promotes(spark):
    cases = spark.createDataFrame([("a", 1, "t", "2024", True, "indictment", "m", ""), ("b", 2, "t", "2024", True, "unknown", "m", ""), ("c", 3, "t", "2024", True, "conviction", "m", ""), ("d", 4, "t", "2024", None, "plea", "m", "")], "link string, row_ord int, title string, year string, verdict boolean, posture string, model string, role string")
    methods = spark.createDataFrame([(1, "adjudicated"), (2, "adjudicated"), (3, "reported"), (4, "adjudicated")], "row_ord int, claim_status string")
    got = {r.link: (r.strength, r.capped) for r in L.case_strength(cases, methods).collect()}
    assert got == {"a": ("alleged", True), "b": ("adjudicated", False), "c": ("reported", False)}


def test_longer_vendor_alias_uses_up_the_shorter(spark):
    rows = spark.createDataFrame([("l1", "a Blue Bolt and bolts", True), ("l2", "blue sky, bolt", False)], "link string, text string, verdict boolean")
    got = {(r.vendor, r.link) for r in V.mentions(rows, [("c", "BB", ["blue bolt"]), ("c", "B", ["blue"]), ("d", "Bolt", ["bolt"])]).collect()}
    assert got == {("BB", "l1"), ("B", "l2"), ("Bolt", "l2")}


def test_embedding_is_unit_and_counts_terms():
    assert S.embed("") == [0.0] * 256
    a, b = S.embed("aa aa bb"), S.embed("aa bb")
    assert abs(sum(x * x for x in a) - 1) < 1e-12 and a != b


def test_limiter_does_not_count_denied(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 10, 11, 21])], "user_id long, event_id long, ts timestamp")
    got = {r.event_id: r.admitted for r in I.admitted(rows, "user_id", 2, 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}


def test_compaction_is_idempotent(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "link string, ord int, v string")
    once = I.last_wins(rows, "link", ["ord"]).select("link", "ord", "v")
    assert sorted(once.collect()) == sorted(I.last_wins(once, "link", ["ord"]).select("link", "ord", "v").collect()) == [("a", 3, "z"), ("b", 2, "y")]


PAGE = """<html><head><title> A  page </title><meta property="og:title" content="Shared"><meta name="date" content="2024-05-01"><style>x{}</style></head>
<body><p>One &amp; two</p><script>var a="<p>";</script><a href="/docs/a.html">a</a><a href="b.html">b</a><a href="b.html">b</a><a href="http://other/x">o</a></body></html>"""


def test_page_parts_and_links(spark):
    df = spark.createDataFrame([(1, "http://h/docs/index.html", PAGE), (2, "http://h/", None)], "id int, url string, html string")
    got = df.orderBy("id").select(P.page_parts("html").alias("p")).collect()
    assert got[0].p.title == "Shared" and got[0].p.published == "2024-05-01" and got[0].p.text == "One & two a b b o"
    assert got[1].p.title == "" and got[1].p.links == []
    spark.udtf.register("same_site_links", P.SameSiteLinks)
    df.createOrReplaceTempView("pages_here")
    links = spark.sql("SELECT l.* FROM pages_here, LATERAL same_site_links(url, html) l ORDER BY nth").collect()
    assert [tuple(r) for r in links] == [(1, "http://h/docs/a.html"), (2, "http://h/docs/b.html")]
    assert one(spark, P.plain_text(F.col("t")), t="a  b") == "a b"


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"link": "x", "n": 1}\n\n{broken\n{"link": "y", "n": 2}\n')
    schema = T.StructType([T.StructField("link", T.StringType()), T.StructField("n", T.IntegerType())])
    assert sorted(r.link for r in P.jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()) == ["x", "y"]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>http://l</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item><item><title>no link</title></item></channel></rss>")
    rows = P.feed_items(spark, str(tmp_path / "f.xml")).select("title", F.unix_timestamp("published").alias("s")).collect()
    assert [tuple(r) for r in rows] == [("T", 1704164645)]


def test_payload_mappers(spark):
    tweet = json.dumps({"data": [{"id": "5", "text": "t" * 600, "created_at": "2024-01-01T00:00:00Z"}]})
    post = json.dumps({"data": {"children": [{"kind": "t3", "data": {"title": "A", "permalink": "/r/a", "selftext": "b", "score": 3, "num_comments": 2, "created_utc": 1.0, "stickied": False}}, {"kind": "t3", "data": {"title": "pinned", "stickied": True}}]}})
    df = spark.createDataFrame([(tweet, post)], "t string, p string")
    (t,), (p,) = df.select(P.tweets(F.col("t")), P.listing_posts(F.col("p"))).first()
    assert len(t.title) == 120 and len(t.summary) == 500 and t.link.endswith("/5")
    assert p.title == "A" and p.summary == "b [3 points, 2 comments]"


def test_streams_equal_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = E.drain(E.tumbling(E.read_events(spark, SF)).select("window", "event_type", "n"), f"file://{tmp_path}/tumbling")
    want = {(r.window.start, r.event_type): r.n for r in batch.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = {(r.window.start, r.event_type): r.n for r in got.collect()}
    assert rows and all(want[k] == n for k, n in rows.items()) and len(want) - len(rows) < 12  # the last windows are open
    admitted = E.drain(E.admit(E.read_events(spark, SF), 3, 6 * 3600), f"file://{tmp_path}/admit")
    assert sorted(admitted.collect()) == sorted(I.admitted(batch, "user_id", 3, 6 * 3600).select("user_id", "event_id", "admitted").collect())
    kept = store.VersionedStore(spark, f"file://{tmp_path}/store", "user_id long, ts timestamp, event_id long", "user_id", ["ts", "event_id"])
    store.upsert_stream(E.read_events(spark, SF).select("user_id", "ts", "event_id"), kept, f"file://{tmp_path}/state")
    assert {(r.user_id, r.event_id) for r in kept.read().collect()} == {(r.user_id, r.event_id) for r in I.last_wins(batch.select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"]).collect()}


def test_plans(spark):
    """Column pruning reaches the scan; lexicon matching adds no join and no shuffle; no cartesian product."""
    plan = M.technique_hits(fixtures.articles(spark, SF), fixtures.TAXONOMY).select("link", "hits")._jdf.queryExecution().toString()
    assert not any(x in plan.split("Physical Plan")[1] for x in ("HashJoin", "MergeJoin", "NestedLoop", "Exchange"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    strong = L.case_strength(fixtures.cases(spark, SF), fixtures.methods(spark, SF))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in strong and "o_orderstatus" in strong.split("PushedFilters")[1]


def test_small_text_functions(spark):
    df = spark.createDataFrame([(["Alpha", " alpha ", "x", "IF001", "Beta"], "Court: C\nDocket: 1:23 \nx", "https://h/docket/77/a/", " @Some_One ", "Hello, World! ", "Expected available in 5000 seconds.")], "a array<string>, t string, u string, h string, s string, e string")
    none = F.array().cast("array<string>")
    got = df.select(
        X.operator_terms(F.col("a"), none, none, none), X.labelled_line(F.col("t"), "Docket"), X.labelled_line(F.col("t"), "Cause"), X.number_in_path(F.col("u"), "docket"),
        X.handle(F.col("h")), X.slug(F.col("s")), X.wait_seconds(F.col("e")),
    ).first()
    assert tuple(got) == (["Alpha", "Beta"], "1:23", None, 77, "some_one", "hello-world", 3600)
    terms = spark.createDataFrame([("a@b",), ("Acme Inc.",), ("John Smith",), ("copied files",)], "t string")
    assert [r[0] for r in terms.select(X.is_entity_term(F.col("t"))).collect()] == [True, True, True, False]

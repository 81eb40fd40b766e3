"""Queries of the incremental side: stores, generations, budgets, audits, windows, parsing, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.operators import incremental as I
from caselode.operators import matching as M
from caselode.plans.reading import HITS, SCORED, scored
from caselode.sources import fixtures as X
from caselode.sources import parsing as P
from caselode.sources import shared
from caselode.streaming import events as E

A = X.ARTICLE_SQL
EVENTS = "e AS (SELECT event_id, ts, user_id, event_type, value, props FROM events)"


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def last_wins(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    return I.last_wins(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def _stores(spark, sf_dir):
    a = X.articles(spark, sf_dir).select("row_ord", "link", "title", "summary", "content")
    store = a.where("row_ord % 3 <> 0").withColumn("content", F.when(F.col("row_ord") % 7 != 0, F.col("content")).otherwise(""))
    new = a.where("row_ord % 2 = 0 or row_ord % 3 = 0").withColumn("title", F.when(F.col("row_ord") % 10 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return store, new


def merge_refresh(spark, sf_dir):
    store, new = _stores(spark, sf_dir)
    return I.merge_refresh(store, new).select("link", "action", F.length("content").alias("n"))


def append_new(spark, sf_dir):
    store, new = _stores(spark, sf_dir)
    return I.append_new(store, new, "link", ["row_ord"]).select("link", "title")


def incremental_worklist(spark, sf_dir):
    a = X.articles(spark, sf_dir)
    late = F.when(F.col("row_ord") % 4 == 0, F.col("ingested_at") - F.expr("interval 1 day")).otherwise(F.col("processed_at"))
    done = a.where("row_ord % 5 <> 0").withColumn("processed_at", late)
    return I.stale_rows(a, done).select("link", "channel", "nth")


def export_rows(spark, sf_dir):
    """Score floor and date, without the bypass for publications."""
    since = F.timestamp_seconds(F.lit(1704067200 + 90 * 3600))
    keep = (F.col("relevance_score") >= 0.15) & (F.coalesce("published", "processed_at") >= since)
    return scored(spark, sf_dir).where(keep).select("link", "relevance_score")


def _history(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return item.select(
        F.col("l_orderkey").alias("link"),
        F.row_number().over(order).alias("gen"),
        (F.col("l_linenumber") % 3 + 1).alias("schema"),
        (F.col("l_returnflag") == "A").alias("verdict"),
        F.bround(F.col("l_discount") * 10, 4).alias("confidence"),
        (F.col("l_quantity").cast("int") % 5).alias("n_methods"),
        (F.col("l_linestatus") == "F").alias("has_note"),
    )


HISTORY = """history AS (SELECT l_orderkey AS link, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INTEGER) AS gen,
  l_linenumber % 3 + 1 AS schema, l_returnflag = 'A' AS verdict, round_even(l_discount * 10, 4) AS confidence, CAST(l_quantity AS INTEGER) % 5 AS n_methods, l_linestatus = 'F' AS has_note FROM lineitem),
rich AS (SELECT *, 100 * has_note::INT + 10 * n_methods + confidence AS rich FROM history)"""


def select_best_generation(spark, sf_dir):
    return I.best_generation(_history(spark, sf_dir))


def append_dedupe(spark, sf_dir):
    h = _history(spark, sf_dir)
    return I.append_generations(h.where("gen % 2 = 1"), h.where("gen % 2 = 0")).select("link", "gen")


def budget_prefix(spark, sf_dir):
    return I.budget_prefix(_events(spark, sf_dir), "user_id", ["ts", "event_id"], 300, 2700, 5).select("user_id", "event_id", "spent", "nth")


def char_budget_concat(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    return I.concat_within(rows, "conv_id", "turn", "text", 400).select("conv_id", "parts", F.sha2("joined", 256).alias("joined_sha"))


def goldset_sample(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "row_ord")
    size = F.when(F.length("content") < 1000, "short").when(F.length("content") >= 3000, "long").otherwise("mid")
    rows = X.articles(spark, sf_dir).join(labels, "row_ord").select("link", "source_id", size.alias("size"), (F.col("toxic") == 1).alias("verdict"))
    return I.round_robin_sample(rows, ["source_id", "size"], "verdict", "link", 42, 40).select("link", "k", "verdict")


def goldset_strata(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.length("text").alias("n"))
    size = F.when(F.col("n") < 1000, "short").when(F.col("n") >= 3000, "long").otherwise("mid")
    return docs.join(labels, "doc_id").groupBy("source", size.alias("size"), "toxic").agg(F.count(F.lit(1)).alias("n_rows"))


def ab_metrics(spark, sf_dir):
    """The two labels as two arms: sizes, rates to four places, agreement, and lengths of each verdict's texts."""
    both = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.length("text").cast("double").alias("n")), "doc_id")
    return both.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.bround(F.avg(F.col("quality").cast("double")), 4).alias("rate_a"),
        F.bround(F.avg(F.col("toxic").cast("double")), 4).alias("rate_b"),
        F.bround(F.avg((F.col("quality") == F.col("toxic")).cast("double")), 4).alias("agreement"),
        F.bround(F.avg("n"), 3).alias("mean_n"),
        F.bround(F.median("n"), 3).alias("median_n"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
    )


def corpus_audit(spark, sf_dir):
    """Filings with and without a body, stubs and stale rows, in one pass."""
    filing, n = F.col("channel") == "filings", F.length("content")
    return X.articles(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(filing).alias("filings"),
        F.count_if(filing & (n >= 1500)).alias("with_body"),
        F.count_if(filing & (n < 1500)).alias("stubs"),
        F.count_if(F.col("published").isNull()).alias("undated"),
        F.count_if(F.col("published") < F.col("ingested_at") - F.expr("interval 50 days")).alias("stale"),
    )


def verdict_crosstab(spark, sf_dir):
    """Cases by posture, by model, and in all, for each verdict: three passes in one."""
    sets = [[F.col("verdict"), F.col("posture")], [F.col("verdict"), F.col("model")], [F.col("verdict")]]
    return X.cases(spark, sf_dir).where("verdict is not null").groupingSets(sets, "verdict", "posture", "model").agg(F.count(F.lit(1)).alias("cases"))


def _cycles(spark, sf_dir):
    hour = F.floor(F.unix_timestamp("ts") / 3600).alias("cycle")
    by = _events(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("lane"), hour).agg(
        F.count_if(F.col("event_type") == "purchase").alias("good"), F.count_if(F.col("event_type") == "error").alias("bad"), F.count(F.lit(1)).alias("fetched")
    )
    return by.withColumn("outcome", F.when(F.col("good") > 0, "ok").when(F.col("bad") > 0, "failed").otherwise("skipped"))


def lane_health(spark, sf_dir):
    """Consecutive failures at each cycle, and whether the lane counts as broken (three or more)."""
    runs = I.failure_runs(_cycles(spark, sf_dir))
    return runs.select("lane", "cycle", "outcome", "failures", (F.col("failures") >= 3).alias("broken"))


def lane_summary(spark, sf_dir):
    return _cycles(spark, sf_dir).groupBy("lane", "outcome").agg(F.count(F.lit(1)).alias("cycles"), F.sum("fetched").alias("fetched"))


def quarterly_spend(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    quarter = F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate"))
    return orders.groupBy(quarter.alias("quarter")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


def quote_verbatim(spark, sf_dir):
    """Every benchmark passage that stands verbatim in a document."""
    return M.quotes_found(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def quote_stamps(spark, sf_dir):
    """The title of the article before as a quote of each article: verbatim, not, or blank."""
    a = X.articles(spark, sf_dir)
    quote = a.select((F.col("row_ord") + 1).alias("row_ord"), F.substring("title", 1, 12).alias("quote"))
    return a.select("row_ord", "content").join(quote, "row_ord").select("row_ord", T.quote_is_verbatim(F.col("quote"), F.col("content")).alias("verbatim"))


def tumbling(spark, sf_dir):
    w = F.window("ts", "6 hours")
    by = _events(spark, sf_dir).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("value"), 2).alias("total"))
    return by.select(F.unix_timestamp("window.start").alias("start_s"), "event_type", "n", "total")


def sliding(spark, sf_dir):
    by = _events(spark, sf_dir).groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return by.select(F.unix_timestamp("window.start").alias("start_s"), "n", "users")


def session_windows(spark, sf_dir):
    found = I.sessions(_events(spark, sf_dir), "user_id", "ts", 1800)
    return found.select("user_id", F.col("nth").cast("long").alias("nth"), "events", F.unix_micros("opened").alias("opened_us"), F.unix_micros("closed").alias("closed_us"))


def json_props(spark, sf_dir):
    """Malformed JSON gives null, not an error."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return _events(spark, sf_dir).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def needs_full_text(spark, sf_dir):
    """Filings whose body is empty or a single line."""
    keep = (F.col("channel") == "filings") & ((F.col("content") == "") | (F.instr("content", "\n") == 0))
    return X.articles(spark, sf_dir).where(keep).select("link")


def admit_limiter(spark, sf_dir):
    return I.admitted(_events(spark, sf_dir), "user_id", 3, 6 * 3600)


def novel_clusters(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return I.leader_clusters(rows, 0.72, F.col("label"))


def html_title(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", P.page_parts("html").alias("p"))
    return pages.select("page_id", "p.title", "p.description", "p.published")


def html_links(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", P.page_parts("html")["links"].alias("links"))
    return pages.select("page_id", F.posexplode("links").alias("nth", "url"))


def plain_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.length(P.plain_text(F.col("html"))).alias("n_chars"))


def stream_tumbling(spark, sf_dir):
    """The tumbling counts from a stream run to its end; windows that the watermark has closed."""
    rows = E.tumbling(E.read_events(spark, sf_dir)).select("window", "event_type", "n")
    done = E.drain(rows, shared.fresh_path(spark, "stream"))
    return done.select(F.unix_timestamp("window.start").alias("start_s"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        last_wins, merge_refresh, append_new, incremental_worklist, export_rows, select_best_generation, append_dedupe, budget_prefix,
        char_budget_concat, goldset_sample, goldset_strata, ab_metrics, corpus_audit, verdict_crosstab, lane_health, lane_summary,
        quarterly_spend, quote_verbatim, quote_stamps, tumbling, sliding, session_windows, json_props, needs_full_text, admit_limiter,
        novel_clusters, html_title, html_links, plain_text, stream_tumbling,
    )
}

_STORES = f"""{A}, store AS (SELECT link, title, summary, CASE WHEN row_ord % 7 <> 0 THEN content ELSE '' END AS content FROM article WHERE row_ord % 3 <> 0),
fresh AS (SELECT link, CASE WHEN row_ord % 10 = 0 THEN title || '!' ELSE title END AS title, summary, content FROM article WHERE row_ord % 2 = 0 OR row_ord % 3 = 0)"""
_PLAIN = lambda t: f"trim(regexp_replace(translate(lower({t}), '‘’“”–—', '\'\'\'\'\"\"--'), '\\s+', ' ', 'g'))"
_SIZE = lambda n: f"CASE WHEN {n} < 1000 THEN 'short' WHEN {n} >= 3000 THEN 'long' ELSE 'mid' END"
_CYCLES = f"""{EVENTS}, c AS (SELECT user_id % 7 AS lane, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS cycle, count(*) AS fetched,
  CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'ok' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' ELSE 'skipped' END AS outcome FROM e GROUP BY 1, 2)"""
ORACLE_SQL = {
    "last_wins": f"WITH {EVENTS} SELECT user_id, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "merge_refresh": f"""WITH {_STORES} SELECT link, CASE WHEN f.link IS NULL THEN 'kept' WHEN s.link IS NULL THEN 'inserted' WHEN (f.title, f.summary) <> (s.title, s.summary) OR (s.content = '' AND f.content <> '') THEN 'replaced' ELSE 'kept' END AS action,
        length(CASE WHEN f.link IS NULL OR (s.link IS NOT NULL AND (f.title, f.summary) = (s.title, s.summary) AND NOT (s.content = '' AND f.content <> '')) THEN s.content ELSE f.content END) AS n FROM store s FULL OUTER JOIN fresh f USING (link)""",
    "append_new": f"WITH {_STORES} SELECT link, title FROM fresh WHERE link NOT IN (SELECT link FROM store)",
    "incremental_worklist": f"""WITH {A} SELECT link, channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY published DESC NULLS LAST, row_ord) AS INTEGER) AS nth FROM article WHERE row_ord % 5 = 0 OR row_ord % 4 = 0""",
    "export_rows": f"WITH {SCORED} SELECT link, relevance_score FROM scored WHERE relevance_score >= 0.15 AND coalesce(published, processed_at) >= TIMESTAMP '2024-01-04 18:00:00'",
    "select_best_generation": f"""WITH {HISTORY}, n AS (SELECT * FROM rich QUALIFY schema = max(schema) OVER (PARTITION BY link)),
        v AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY link, verdict ORDER BY rich DESC, gen DESC) = 1)
        SELECT link, gen, verdict, confidence FROM v QUALIFY row_number() OVER (PARTITION BY link ORDER BY confidence DESC, rich DESC, gen DESC) = 1""",
    "append_dedupe": f"""WITH {HISTORY} SELECT link, gen FROM history h WHERE gen % 2 = 0 AND NOT EXISTS (SELECT 1 FROM history o WHERE o.gen % 2 = 1 AND o.link = h.link AND o.schema = h.schema
        AND o.verdict = h.verdict AND o.n_methods = h.n_methods AND o.has_note = h.has_note AND o.confidence = h.confidence)""",
    "budget_prefix": f"""WITH {EVENTS} SELECT user_id, event_id, 300 * row_number() OVER w AS spent, CAST(row_number() OVER w AS INTEGER) AS nth FROM e
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY spent <= 2700 AND nth <= 5""",
    "char_budget_concat": """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
        SELECT conv_id, count(*) AS parts, sha256(string_agg(substr(text, 1, CAST(400 - before AS INTEGER)), chr(10) ORDER BY turn)) AS joined_sha FROM c WHERE before < 400 GROUP BY conv_id""",
    "goldset_sample": f"""WITH {A}, r AS (SELECT link, source_id || '|' || {_SIZE("length(content)")} AS cell, toxic = 1 AS verdict, sha256('42:' || link) AS h FROM article JOIN labels ON doc_id = row_ord WHERE toxic IS NOT NULL),
        a AS (SELECT *, row_number() OVER (PARTITION BY cell, verdict ORDER BY h, link) AS r FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY r, sha256(cell), cell) AS k FROM a)
        SELECT link, CAST(k AS INTEGER) AS k, verdict FROM b ORDER BY k, verdict DESC LIMIT 40""",
    "goldset_strata": f"SELECT source, {_SIZE('length(text)')} AS size, toxic, count(*) AS n_rows FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "ab_metrics": """SELECT count(*) AS pairs, round_even(avg(quality), 4) AS rate_a, round_even(avg(toxic), 4) AS rate_b, round_even(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END), 4) AS agreement,
        round_even(avg(length(text)), 3) AS mean_n, round_even(median(length(text)::DOUBLE), 3) AS median_n, min(length(text))::DOUBLE AS min_n, max(length(text))::DOUBLE AS max_n FROM labels JOIN documents USING (doc_id)""",
    "corpus_audit": f"""WITH {A} SELECT count(*) AS total, count(*) FILTER (channel = 'filings') AS filings, count(*) FILTER (channel = 'filings' AND length(content) >= 1500) AS with_body,
        count(*) FILTER (channel = 'filings' AND length(content) < 1500) AS stubs, count(*) FILTER (published IS NULL) AS undated, count(*) FILTER (published < ingested_at - INTERVAL 50 DAY) AS stale FROM article""",
    "verdict_crosstab": f"WITH {X.CASES_SQL} SELECT verdict, posture, model, count(*) AS cases FROM cases WHERE verdict IS NOT NULL GROUP BY GROUPING SETS ((verdict, posture), (verdict, model), (verdict))",
    "lane_health": f"""WITH {_CYCLES}, i AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY cycle) AS island FROM c),
        f AS (SELECT *, CAST(sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY lane, island ORDER BY cycle) AS BIGINT) AS failures FROM i) SELECT lane, cycle, outcome, failures, failures >= 3 AS broken FROM f""",
    "lane_summary": f"WITH {_CYCLES} SELECT lane, outcome, count(*) AS cycles, CAST(sum(fetched) AS BIGINT) AS fetched FROM c GROUP BY lane, outcome",
    "quarterly_spend": "SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1",
    "quote_verbatim": f"""WITH d AS (SELECT doc_id, {_PLAIN("coalesce(text, '')")} AS body FROM documents), b AS (SELECT item_id, {_PLAIN("coalesce(text, '')")} AS quote FROM benchmark)
        SELECT doc_id, item_id FROM d JOIN b ON contains(body, quote) WHERE quote <> ''""",
    "quote_stamps": f"""WITH {A}, q AS (SELECT row_ord + 1 AS row_ord, {_PLAIN("substr(title, 1, 12)")} AS quote FROM article)
        SELECT row_ord, CASE WHEN quote <> '' THEN contains({_PLAIN("content")}, quote) END AS verbatim FROM article JOIN q USING (row_ord)""",
    "tumbling": f"WITH {EVENTS} SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')) AS BIGINT) AS start_s, event_type, count(*) AS n, round_even(sum(value), 2) AS total FROM e GROUP BY 1, 2",
    "stream_tumbling": f"""WITH {EVENTS}, w AS (SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')) AS BIGINT) AS start_s, event_type, count(*) AS n FROM e GROUP BY 1, 2)
        SELECT start_s, event_type, n FROM w WHERE start_s + 21600 <= (SELECT epoch(max(ts)) - 3600 FROM e)""",
    "sliding": f"""WITH {EVENTS}, s AS (SELECT epoch(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01')) - 43200 * unnest([0, 1]) AS s, user_id FROM e)
        SELECT CAST(s AS BIGINT) AS start_s, count(*) AS n, count(DISTINCT user_id) AS users FROM s GROUP BY 1""",
    "session_windows": f"""WITH {EVENTS}, l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e),
        n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS nth FROM l) SELECT user_id, nth, count(*) AS events, epoch_us(min(ts)) AS opened_us, epoch_us(max(ts)) AS closed_us FROM n GROUP BY user_id, nth""",
    "json_props": f"WITH {EVENTS} SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM e GROUP BY 1",
    "needs_full_text": f"WITH {A} SELECT link FROM article WHERE channel = 'filings' AND NOT contains(content, chr(10))",
}

"""Queries of paged sources, versioned stores, clocks and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselode.operators import history as H
from caselode.operators import incremental as I
from caselode.operators import similar
from caselode.plans import nightly as N
from caselode.sources import fixtures as X
from caselode.sources import paged, shared, sitemaps
from caselode.streaming import clocks, store, sweep, trends
from caselode.streaming import events as E

PAGE, MAX_PAGES, FILED_AFTER = 250, 5, "2024-01-03"
EVERY = 2 * 86400
WINDOW_DAYS, PER_RUN = 730, 2


def paged_search(spark, sf_dir):
    """Searches by source over landed pages, five a search, from a first day; each link once a search.

    Pages hold the documents of 250 ids, and the first one of the page that follows, as pages of a live search do.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    page = F.floor(F.col("doc_id") / PAGE).cast("int")
    both = F.when((F.col("doc_id") % PAGE == 0) & (page > 0), F.array(page - 1, page)).otherwise(F.array(page))
    filed = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600), "yyyy-MM-dd")
    hits = docs.select(F.col("source").alias("query"), F.explode(both).alias("page"), F.format_string("doc:%012d", "doc_id").alias("link"), F.substring("text", 1, 60).alias("title"), filed.alias("filed"), F.substring("text", 1, 200).alias("body"))
    path = shared.fresh_path(spark, "pages")
    paged.land(hits, path)
    found = paged.each_link_once(paged.read_pages(spark, path, max_pages=MAX_PAGES).where(F.col("filed") >= FILED_AFTER), ["query"])
    return found.select("query", "page", "link", "filed", F.length("body").alias("n"))


def versioned_store(spark, sf_dir):
    """The last event of each user, from a store that five batches came into and that was folded once on the way."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts", "event_id", "event_type")
    kept = store.VersionedStore(spark, shared.fresh_path(spark, "store"), rows.schema, "user_id", ["ts", "event_id"])
    for number in range(5):
        kept.append(rows.where(F.pmod(F.dayofmonth("ts"), F.lit(5)) == number), number)
        if number == 2:
            kept.compact()
    return kept.read().select("user_id", "event_id", "event_type")


def recheck_clock(spark, sf_dir):
    """Whether a user is due to be checked at each event: two days after the last genuine check, never again after the end."""
    genuine, ended = F.col("event_type") != "error", (F.col("event_type") == "purchase") & (F.col("event_id") % 50 == 0)
    asks = E.read_events(spark, sf_dir).select(F.col("user_id").alias("link"), F.unix_timestamp("ts").alias("t"), F.col("event_id").alias("nth"), genuine.alias("genuine"), ended.alias("ended"))
    return E.drain(clocks.due_checks(asks, EVERY, 10**9, late="10000 days"), shared.fresh_path(spark, "clock"))


def history_sweep(spark, sf_dir):
    """A sweep over all orders, backwards in windows, two priorities a run, those that were left out before first; the orders of each request."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("query"))
    span = orders.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.array_sort(F.collect_set("query")).alias("queries")).first()
    if span["first"] is None:
        return spark.createDataFrame([], f"{sweep.SCHEMA}, orders long").drop("place")
    floor = spark.range(1).select(F.date_sub(F.lit(span["first"]), 1).cast("string")).first()[0]
    asked = sweep.sweep(spark, sweep.gap_first(span["queries"], span["queries"][:2]), span["last"].isoformat(), floor, days=WINDOW_DAYS, per=PER_RUN)
    requests = sweep.run_to_the_floor(asked, shared.fresh_path(spark, "sweep"))
    days = orders.groupBy("query", "day").agg(F.count(F.lit(1)).alias("n"))
    inside = (F.col("day") > F.col("first_day")) & (F.col("day") <= F.col("last_day"))
    # one row for each window and priority: small whatever the orders are
    found = requests.join(days, "query", "left").groupBy("first_day", "last_day", "slice", "query").agg(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("orders"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select(day("first_day"), day("last_day"), "slice", "query", "orders")


ROOT = "http://site.example/s/0-news.xml"
WALK = {"hints": ["/en/"], "preferred": ["news"], "skipped": ["video"], "max_sitemaps": 40, "max_urls": 500}


def sitemap_walk(spark, sf_dir):
    """A walk over sitemaps that name each other, ten pages each, news first and without videos: the first English pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    n = pages.count() // 10 + 1
    k = lambda c: F.concat(F.lit("http://site.example/s/"), c, F.when(c % 3 == 0, "-news").otherwise(""), F.when(c % 11 == 5, "-video").otherwise(""), F.lit(".xml"))
    ids = spark.range(n)
    children = F.posexplode(F.array((F.col("id") * 7 + 3) % n, F.col("id") * 2 + 2, F.col("id") * 2 + 1)).alias("nth", "to")
    entries = ids.select(F.col("id"), children).where(F.col("to") < n).select(k(F.col("id")).alias("parent"), "nth", k(F.col("to")).alias("child"))
    listed = pages.select(k(F.pmod("page_id", F.lit(n))).alias("sitemap"), F.col("page_id").alias("nth"), "url")
    return sitemaps.walk(entries, listed, ROOT, **WALK)


def history_backfill(spark, sf_dir):
    """Quotes of two generations stamped anew in place; the stamps of each article and whether one is another than before."""
    a = X.articles(spark, sf_dir).select("row_ord", "link", "title", F.col("content").alias("body"))
    method = lambda quote, stamp: F.struct(quote.alias("quote"), F.lit(stamp).cast("boolean").alias("verbatim"))
    old = F.array(method(F.substring("title", 1, 12), None), method(F.lit("never said"), True))
    new = F.when(F.col("row_ord") % 5 != 0, F.array(method(F.substring("body", 11, 40), True)))
    generation = lambda model, ms: F.struct(F.lit(model).alias("model"), ms.alias("methods"))
    rows = a.withColumn("history", F.array(generation("a", old), generation("b", new)))
    done = H.stamp_history(rows)
    stamps = F.transform("history", lambda g: F.coalesce(F.array_join(F.transform(g["methods"], lambda m: m["verbatim"].cast("string")), ",", "none"), F.lit("-")))
    return done.select("link", "changed", F.array_join(stamps, "|").alias("stamps"))


def keep_best(spark, sf_dir):
    """The last even generation of each link after a run, against a snapshot of the last odd one: what was richer before comes back."""
    history = N._history(spark, sf_dir).withColumn("rich", I.richness())
    last = lambda odd: history.where(F.col("gen") % 2 == odd).groupBy("link").agg(F.max_by(F.struct("gen", "rich"), "gen").alias("g")).select("link", "g.*")
    return H.keep_best(last(1), last(0), "link", "rich")


def rolling_trends(spark, sf_dir):
    """Users of each type of event in the last seven whole days and in the seven before: counted, and whether the merged sketches of a stream agree within 5 %."""
    named = lambda df: df.select(F.col("event_type").alias("key"), F.col("user_id").alias("story"), F.col("ts").alias("stamp"))
    sketches = E.drain(trends.daily_sketches(named(E.read_events(spark, sf_dir))), shared.fresh_path(spark, "sketches"))
    rows = named(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    days = rows.select(F.to_date("stamp").alias("day"), "key", "story").distinct().join(F.broadcast(sketches.select("day").distinct()), "day", "left_semi")  # one row a day
    guess = trends.rolling(sketches).select("key", F.col("recent").alias("r"), F.col("prior").alias("p"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.col(b) * 0.05
    return trends.rolling_exact(days).join(guess, "key", "left").withColumn("agrees", F.coalesce(close("r", "recent") & close("p", "prior"), F.lit(False))).drop("r", "p")


SIMILAR = 0.85


def similar_clusters(spark, sf_dir):
    """Clusters of vectors that lean towards the first of their four, across labels; links of cosine 0.85, each met with probability 0.9999."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    first = rows.select((F.col("vec_id") + 0).alias("lead"), F.col("embedding").alias("towards"))
    both = rows.withColumn("lead", F.col("vec_id") - F.pmod("vec_id", F.lit(4))).join(first, "lead")
    leaning = both.select("vec_id", F.zip_with("embedding", "towards", lambda x, y: x.cast("double") + 2 * y.cast("double")).alias("embedding"))
    return similar.similar_clusters(leaning, SIMILAR, target=0.9999)


QUERIES = {f.__name__: f for f in (rolling_trends, similar_clusters, paged_search, versioned_store, recheck_clock, history_sweep, sitemap_walk, history_backfill, keep_best)}
ORACLE_SQL = {
    "paged_search": f"""WITH h AS (SELECT source AS query, unnest(CASE WHEN doc_id % {PAGE} = 0 AND doc_id >= {PAGE} THEN [doc_id // {PAGE} - 1, doc_id // {PAGE}] ELSE [doc_id // {PAGE}] END) AS p,
          'doc:' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS link, strftime(to_timestamp(1704067200 + doc_id * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d') AS filed, length(substr(text, 1, 200)) AS n FROM documents),
        r AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY query ORDER BY p) AS INTEGER) AS page FROM h)
        SELECT query, min(page) AS page, link, any_value(filed) AS filed, CAST(any_value(n) AS INTEGER) AS n FROM r WHERE page <= {MAX_PAGES} AND filed >= '{FILED_AFTER}' GROUP BY query, link""",
    "versioned_store": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "recheck_clock": f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY t, nth) AS rn FROM (
          SELECT user_id AS link, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS nth, event_type <> 'error' AS genuine, event_type = 'purchase' AND event_id % 50 = 0 AS ended FROM events)),
        r AS (SELECT link, t, nth, rn, true AS due, CASE WHEN genuine THEN t END AS last, ended AS over FROM a WHERE rn = 1
          UNION ALL SELECT link, t, nth, rn, due, CASE WHEN due AND genuine THEN t ELSE last END, over OR (due AND ended) FROM (
            SELECT a.link, a.t, a.nth, a.rn, a.genuine, a.ended, r.last, r.over, NOT r.over AND (r.last IS NULL OR a.t - r.last >= {EVERY}) AS due FROM r JOIN a ON a.link = r.link AND a.rn = r.rn + 1))
        SELECT link, t, nth, due FROM r""",
    "history_sweep": f"""WITH RECURSIVE o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS query FROM orders), s AS (SELECT min(day) - 1 AS floor, max(day) AS newest FROM o),
        w AS (SELECT greatest(floor, newest - {WINDOW_DAYS}) AS first_day, newest AS last_day, floor FROM s UNION ALL SELECT greatest(floor, first_day - {WINDOW_DAYS}), first_day, floor FROM w WHERE first_day > floor),
        p AS (SELECT query, row_number() OVER (ORDER BY query) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT query FROM o)),
        q AS (SELECT query, CAST(CASE WHEN i < least(2, n) THEN n - least(2, n) + i ELSE i - 2 END // {PER_RUN} AS INTEGER) AS slice FROM p)
        SELECT strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day, slice, q.query, count(o.day) AS orders
        FROM w, q LEFT JOIN o ON o.query = q.query AND o.day > first_day AND o.day <= last_day GROUP BY ALL""",
    "sitemap_walk": """WITH RECURSIVE n AS (SELECT count(*) // 10 + 1 AS n FROM pages),
        s AS (SELECT k, 'http://site.example/s/' || k || CASE WHEN k % 3 = 0 THEN '-news' ELSE '' END || CASE WHEN k % 11 = 5 THEN '-video' ELSE '' END || '.xml' AS url FROM (SELECT unnest(range(n)) AS k FROM n)),
        e AS (SELECT k, to_, min(nth) AS nth FROM (SELECT k, unnest([(k * 7 + 3) % n, k * 2 + 2, k * 2 + 1]) AS to_, unnest([0, 1, 2]) AS nth FROM s, n) GROUP BY ALL),
        o AS (SELECT p.url AS parent, list(c.url ORDER BY contains(c.url, 'news') DESC, nth, c.url) AS children FROM e JOIN s p ON p.k = e.k JOIN s c ON c.k = e.to_ WHERE NOT contains(c.url, 'video') AND c.k <> p.k GROUP BY p.url),
        walk(step, queue, seen) AS (SELECT 0, ['http://site.example/s/0-news.xml'], []::VARCHAR[] UNION ALL
          SELECT step + 1, list_concat(list_filter(coalesce(o.children, []), lambda c: NOT list_contains(seen, c) AND NOT list_contains(queue, c)), queue[2:]), list_append(seen, queue[1])
          FROM walk LEFT JOIN o ON o.parent = queue[1] WHERE len(queue) > 0 AND step < 40),
        r AS (SELECT unnest(seen) AS sitemap, generate_subscripts(seen, 1) AS rank FROM (SELECT seen FROM walk ORDER BY step DESC LIMIT 1))
        SELECT CAST(row_number() OVER (ORDER BY rank, page_id, p.url) AS INTEGER) AS place, sitemap, p.url FROM r JOIN s ON s.url = sitemap JOIN pages p ON p.page_id % (SELECT n FROM n) = s.k
        WHERE contains(lower(regexp_extract(p.url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)), '/en/') QUALIFY place <= 500""",
    "history_backfill": f"""WITH {X.ARTICLE_SQL}, p AS (SELECT *, {N._PLAIN("content")} AS plain, {N._PLAIN("substr(title, 1, 12)")} AS q1, {N._PLAIN("substr(content, 11, 40)")} AS q2 FROM article),
        v AS (SELECT *, CASE WHEN q1 <> '' THEN contains(plain, q1) END AS v1, contains(plain, 'never said') AS v2, CASE WHEN q2 <> '' THEN contains(plain, q2) END AS v3 FROM p)
        SELECT link, v1 IS NOT NULL OR NOT v2 OR (row_ord % 5 <> 0 AND v3 IS DISTINCT FROM true) AS changed,
               coalesce(CAST(v1 AS VARCHAR), 'none') || ',' || CAST(v2 AS VARCHAR) || '|' || CASE WHEN row_ord % 5 <> 0 THEN coalesce(CAST(v3 AS VARCHAR), 'none') ELSE '-' END AS stamps FROM v""",
    "keep_best": f"""WITH {N.HISTORY}, l AS (SELECT link, gen, rich FROM rich QUALIFY row_number() OVER (PARTITION BY link, gen % 2 ORDER BY gen DESC) = 1),
        o AS (SELECT * FROM l WHERE gen % 2 = 1), c AS (SELECT * FROM l WHERE gen % 2 = 0)
        SELECT c.link, CASE WHEN o.rich > c.rich THEN o.gen ELSE c.gen END AS gen, CASE WHEN o.rich > c.rich THEN o.rich ELSE c.rich END AS rich, coalesce(o.rich > c.rich, false) AS restored FROM c LEFT JOIN o USING (link)""",
    "similar_clusters": f"""WITH RECURSIVE v AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE + 2 * z[2]::DOUBLE) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 4),
        u AS (SELECT vec_id, list_transform(x, lambda c: c / sqrt(list_dot_product(x, x))) AS x FROM v),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) >= {SIMILAR}),
        r(a, b) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT a AS vec_id, min(b) AS cluster, count(*) AS size FROM r GROUP BY a""",
    "rolling_trends": """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS key, user_id AS story FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
        w AS (SELECT *, (SELECT max(day) FROM e) - day AS back FROM e), c AS (SELECT key, count(DISTINCT story) FILTER (back < 7) AS recent, count(DISTINCT story) FILTER (back BETWEEN 7 AND 13) AS prior FROM w WHERE back < 14 GROUP BY key)
        SELECT key, recent, prior, CASE WHEN prior > 0 THEN round_even((recent - prior) * 100.0::DOUBLE / prior, 1) END AS delta_pct,
               CASE WHEN prior = 0 AND recent > 0 THEN 'new' WHEN recent > prior THEN 'up' WHEN recent < prior THEN 'down' ELSE 'flat' END AS direction, true AS agrees FROM c""",
}

"""Queries of the reading side: matching, filters, search, stories, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.operators import matching as M
from caselode.operators import search as S
from caselode.sources import fixtures as X

A = X.ARTICLE_SQL
TAX = X.values_sql("taxonomy", "technique, title, theme", [t[:3] for t in X.TAXONOMY])
#: one row per (article, technique, alias) that matches
_MATCHES = " UNION ALL ".join(
    f"SELECT row_ord, link, '{t}' AS technique, '{title}' AS title, '{theme}' AS theme, '{a}' AS alias, {k} AS nth FROM low WHERE {T.has_alias_sql('low', a)}"
    for t, title, theme, aliases in X.TAXONOMY
    for k, a in enumerate(aliases)
)
HITS = f"""{A}, low AS (SELECT *, lower(content) AS low FROM article), matches AS ({_MATCHES}),
hits AS (SELECT row_ord, link, technique, title, theme, alias
         FROM matches QUALIFY row_number() OVER (PARTITION BY row_ord, technique ORDER BY length(alias) DESC, nth) = 1)"""
_FRAMED = " + ".join(f"CAST({T.has_alias_sql('low', f)} AS INTEGER)" for f in X.FRAMING)
_THEMES = " + ".join(
    f"least((SELECT count(*) FROM hits h WHERE h.row_ord = l.row_ord AND theme = '{t}') * {w}::DOUBLE, {c}::DOUBLE)" for t, w, c in X.THEME_WEIGHTS
)
_any = lambda ps: " OR ".join([T.has_alias_sql("low", p) for p in ps] or ["false"])
_hit = lambda ts: "EXISTS (SELECT 1 FROM hits h WHERE h.row_ord = l.row_ord AND technique IN (" + ", ".join(f"'{t}'" for t in [*ts, "-"]) + "))"
_UC = ", ".join(
    f"CASE WHEN {_hit(ts)} OR {_any(strong)} OR ({' + '.join([f'CAST({T.has_alias_sql("low", p)} AS INTEGER)' for p in weak])}) >= 2 THEN '{n}' END"
    for n, ts, strong, weak in X.USE_CASES
)
_TYPE = "CASE " + " ".join(f"WHEN {_any(ps)} OR {_hit(ts)} THEN '{n}'" for n, ps, ts in X.INSIDER_TYPES) + " END"
_CVES = "len(list_distinct(regexp_extract_all(upper(summary || ' ' || content), 'CVE-[0-9]{4}-[0-9]{4,7}')))"
_DOMAINS = f"""len(list_filter(list_distinct(regexp_extract_all(lower(summary || ' ' || content), '\\b(?:[a-z0-9-]+\\.)+(?:{"|".join(X.TOP_LEVEL)})\\b')), lambda x: x <> '{X.SKIPPED[0]}'))"""
_INSIDER = f"""(EXISTS (SELECT 1 FROM hits h WHERE h.row_ord = l.row_ord)
              AND (({_FRAMED}) > 0 OR EXISTS (SELECT 1 FROM hits h WHERE h.row_ord = l.row_ord AND theme = 'motive')))"""
SCORED = f"""{HITS}, scored AS (
  SELECT *, CASE WHEN aligned = 'weak' AND len(use_cases) > 0 AND insider_type IS NOT NULL THEN 'insider' ELSE aligned END AS alignment
  FROM (SELECT l.*,
    least(round_even(CASE WHEN {_INSIDER} THEN least({_CVES} * 0.15::DOUBLE, 0.3::DOUBLE) ELSE least({_CVES} * 0.03::DOUBLE, 0.06::DOUBLE) END + {_THEMES}
                     + CASE WHEN ({_FRAMED}) > 0 THEN least(0.08::DOUBLE + ({_FRAMED}) * 0.04::DOUBLE, 0.2::DOUBLE) ELSE 0 END
                     + least({_DOMAINS} * 0.02::DOUBLE, 0.06::DOUBLE)
                     + CASE WHEN length(content) > 80 THEN 0.03::DOUBLE ELSE 0 END, 4), 1.0::DOUBLE) AS relevance_score,
    CASE WHEN {_INSIDER} THEN 'insider' ELSE 'weak' END AS aligned,
    list_filter([{_UC}], lambda x: x IS NOT NULL) AS use_cases, {_TYPE} AS insider_type
    FROM low l))"""


def matched(spark, sf_dir: str) -> DataFrame:
    return M.technique_hits(X.articles(spark, sf_dir), X.TAXONOMY)


def processed(articles: DataFrame) -> DataFrame:
    """The processing chain: match, score, align, classify, promote. Each step's columns are computed once a row."""
    both = F.concat_ws(" ", "summary", "content")
    phrases = [*X.FRAMING, *[p for _, _, strong, weak in X.USE_CASES for p in strong + weak], *[p for _, ps, _ in X.INSIDER_TYPES for p in ps]]
    found = M.hits_and_phrases(articles, X.TAXONOMY, phrases)
    parts = {
        "framed": M.terms_found(F.col("said"), X.FRAMING),
        "use_cases": M.use_cases(F.col("said"), X.USE_CASES),
        "insider_type": M.insider_type(F.col("said"), X.INSIDER_TYPES),
        "n_cves": F.size(T.cves(both)),
        "n_domains": F.size(T.domains(both, X.TOP_LEVEL, X.SKIPPED)),
    }
    found = M.computed(found, parts).drop("said")
    aligned = M.alignment(F.col("framed"))
    score = M.relevance(X.THEME_WEIGHTS, F.col("framed"), F.col("n_cves"), F.col("n_domains"), aligned == "weak")
    found = M.computed(found, {"relevance_score": score, "aligned": aligned}).drop("framed", "n_cves", "n_domains")
    return found.withColumn("alignment", M.promoted(F.col("aligned"), F.col("use_cases"), F.col("insider_type")))


def scored(spark, sf_dir: str) -> DataFrame:
    return processed(X.articles(spark, sf_dir))


def technique_counts(spark, sf_dir):
    return M.technique_counts(matched(spark, sf_dir), X.taxonomy(spark)).orderBy(F.desc("articles"), "technique")


def technique_hits(spark, sf_dir):
    return matched(spark, sf_dir).select("row_ord", F.inline("hits")).select("row_ord", "technique", "theme", "alias")


def cve_domain_extract(spark, sf_dir):
    both = F.concat_ws(" ", "summary", "content")
    found = X.articles(spark, sf_dir).select("link", F.array_join(T.cves(both), ",").alias("cves"), F.array_join(T.domains(both, X.TOP_LEVEL, X.SKIPPED), ",").alias("domains"))
    return found.where("cves <> '' or domains <> ''")


def relevance_score(spark, sf_dir):
    return scored(spark, sf_dir).select("link", "relevance_score", "alignment")


def use_case_labels(spark, sf_dir):
    return scored(spark, sf_dir).select("link", F.array_join("use_cases", ",").alias("use_cases"))


def insider_type(spark, sf_dir):
    return scored(spark, sf_dir).select("link", "insider_type")


def article_filters(spark, sf_dir):
    """Channel, score floor with its bypass, alignment and type together."""
    keep = M.in_channel("all") & M.score_floor(F.col("relevance_score"), 0.2) & (F.coalesce("alignment", F.lit("weak")) == "insider")
    keep = keep & ~M.of_type(F.col("insider_type"), "none") & F.array_contains("use_cases", "staff-conduct") & (F.col("source_id") != "src1")
    return scored(spark, sf_dir).where(keep).select("link", "channel", "relevance_score", "insider_type")


def technique_filter(spark, sf_dir):
    """Articles with a technique or a child of it, or whose title, summary or content hold the technique's title or an alias."""
    topics = M.topics_of(matched(spark, sf_dir), X.TAXONOMY)
    found = [M.has_technique(t) | F.array_contains("topics", t) for t in ("PR001", "IF001")]
    return topics.where(found[0] | found[1]).select("link", "title")


def technique_topics(spark, sf_dir):
    """Every article against every technique's topic: its title or an alias in title, summary or content, a hit or not."""
    return M.topics_of(X.articles(spark, sf_dir), X.TAXONOMY).select("row_ord", F.explode("topics").alias("technique"))


def passage_lexicon(spark, sf_dir) -> DataFrame:
    """A large taxonomy from the benchmark: each passage a technique, its runs of one to three words the aliases."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", words.alias("w"))
    rows = rows.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).where(F.size("w") >= F.col("n"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    rows = rows.select(F.concat(F.lit("B"), "item_id").alias("technique"), F.posexplode(runs).alias("nth", "alias"))
    first = rows.groupBy("technique", "alias").agg(F.min("nth").alias("nth")).where(F.length("alias") >= 3)
    return first.select("technique", F.col("technique").alias("title"), F.lit("passage").alias("theme"), "alias", "nth")


def lexicon_hits(spark, sf_dir):
    """The longest alias of each technique in each article, for a lexicon of thousands of aliases that is a table."""
    rows = M.technique_hits(X.articles(spark, sf_dir), passage_lexicon(spark, sf_dir)).select("row_ord", F.inline("hits"))
    return rows.select("row_ord", "technique", "alias")


def control_filter(spark, sf_dir):
    """Articles with a technique that a control covers, by a semi-join on exploded ids."""
    covered = X.controls(spark).where("control = 'DT002'").select(F.col("technique").alias("covered"))
    ids = matched(spark, sf_dir).select("row_ord", "link", F.explode("hits").alias("h")).select("row_ord", "link", F.col("h.technique").alias("technique"))
    match = (F.col("technique") == F.col("covered")) | F.col("technique").startswith(F.concat("covered", F.lit(".")))
    return ids.join(F.broadcast(covered), match, "left_semi").select("row_ord", "link").distinct()


def article_controls(spark, sf_dir):
    """Detections and preventions of each article's techniques, distinct and sorted."""
    ids = matched(spark, sf_dir).select("link", F.explode("hits").alias("h")).select("link", F.col("h.technique").alias("technique"))
    joined = ids.join(F.broadcast(X.controls(spark)), "technique")
    pick = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("control")))), ",")
    return joined.groupBy("link").agg(pick("detection").alias("detections"), pick("prevention").alias("preventions"))


def source_counts(spark, sf_dir):
    """Articles per source with the last name that is not blank."""
    named = F.when(F.col("source_name") != "", F.struct("row_ord", "source_name"))
    return X.articles(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"), F.max(named)["source_name"].alias("name"))


REGISTRY = [("src0", "Source zero"), ("src1", "Source one"), ("src99", "Source without articles")]


def source_counts_merged(spark, sf_dir):
    """Counts merged with the configured sources; either side may be missing."""
    conf = spark.createDataFrame(REGISTRY, "source_id string, configured string")
    both = source_counts(spark, sf_dir).join(conf, "source_id", "full_outer")
    return both.select("source_id", F.coalesce("configured", "name", "source_id").alias("name"), F.coalesce("articles", F.lit(0)).alias("articles"))


QUERY = "thing the license under"


BOOSTED = "cve-2024 pr001 thing the license"


def keyword_search_topk(spark, sf_dir):
    return S.keyword_top(X.articles(spark, sf_dir), QUERY, 20)


def keyword_search_boosted(spark, sf_dir):
    """A query that names a technique, which counts where an article has a hit of it, and the start of a CVE."""
    named = F.concat_ws(" ", "summary", F.transform("hits", lambda h: h["technique"]))
    rows = matched(spark, sf_dir).withColumn("summary", named)
    return S.keyword_top(rows, BOOSTED, 20, F.transform("hits", lambda h: h["technique"]))


def hybrid_search_topk(spark, sf_dir):
    return S.hybrid_top(scored(spark, sf_dir), QUERY, 20)


def article_stream(spark, sf_dir):
    """Newest 50 articles of a channel, undated last, by corpus order where equal."""
    rows = X.articles(spark, sf_dir).where(M.in_channel("news")).orderBy(F.desc_nulls_last("published"), "row_ord").limit(50)
    return rows.select("link", "title", F.unix_timestamp("published").alias("published_s"))


def has_note(row_ord):
    """The test tables hold no analyst notes: every seventh article stands for one that has a note."""
    return row_ord % 7 == 0


def _keyed(articles: DataFrame) -> DataFrame:
    key = T.story_key(F.col("title"), F.col("published"), F.col("processed_at"))
    return M.computed(articles, {"story": key, "norm": T.normalise_title(F.col("title"))})


def story_clusters(spark, sf_dir):
    """Articles of one channel and story; the primary has a note, the best score, the newest date, no social source, in this order."""
    rows = scored(spark, sf_dir).select("row_ord", "link", "title", "channel", "source_id", "source_name", "published", "processed_at", "relevance_score")
    return clusters(_keyed(rows))


def clusters(rows: DataFrame) -> DataFrame:
    ts = F.coalesce(F.unix_timestamp("published"), F.lit(0))
    direct = ~F.lower("source_id").rlike("^(reddit-|tip-)")
    best = F.struct(has_note(F.col("row_ord")).alias("note"), "relevance_score", ts.alias("ts"), direct.alias("direct"), (-F.col("row_ord")).alias("first"), "link")
    other = F.struct(F.lower("source_name").alias("name"), "link")
    by = rows.groupBy("channel", "story").agg(F.count(F.lit(1)).alias("members"), F.max(best).alias("best"), F.array_sort(F.collect_list(other)).alias("all"))
    siblings = F.filter(F.transform("all", lambda o: o["link"]), lambda x: x != F.col("best.link"))
    return by.select(
        "channel",
        "story",
        F.col("best.link").alias("primary_link"),
        F.col("best.ts").alias("newest"),
        F.col("best.relevance_score").alias("score"),
        "members",
        F.array_join(siblings, ",").alias("siblings"),
        F.col("best.first").alias("first"),
    ).drop("first")


def cluster_page(spark, sf_dir):
    """The first 25 clusters: newest primary first, then the better score."""
    return story_clusters(spark, sf_dir).orderBy(F.desc("newest"), F.desc("score"), "story", "channel").limit(25).select("story", "channel", "primary_link")


def syndication_representative(spark, sf_dir):
    """One article for each story: filings first, then the newest; blank titles never stand for each other."""
    rows = _keyed(X.articles(spark, sf_dir).select("row_ord", "link", "title", "channel", "published", "processed_at"))
    alone = F.when(F.col("norm") == "", F.col("row_ord"))
    best = F.struct((F.col("channel") == "filings").alias("filing"), F.col("published").isNotNull().alias("dated"), "published", (-F.col("row_ord")).alias("first"), "link")
    return rows.groupBy("story", alone.alias("alone")).agg(F.max(best)["link"].alias("link")).select("story", "link")


def uncovered_stories(spark, sf_dir):
    """Articles whose story no article with a note covers yet: an anti-join on the story; blank titles are always left."""
    rows = _keyed(X.articles(spark, sf_dir).select("row_ord", "link", "title", "published", "processed_at"))
    covered = rows.where(has_note(F.col("row_ord")) & (F.col("norm") != "")).select("story").distinct()
    return rows.where(~has_note(F.col("row_ord"))).join(covered, "story", "left_anti").select("link", "story")


_STRIPPED = lambda t: f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
_CUT = lambda t: _STRIPPED(f"regexp_replace({t}, '\\s*[|\u2013\u2014-]\\s*[^|]+$', '')")
_NT = f"trim(regexp_replace(regexp_replace({_CUT(_CUT(_STRIPPED('lower(title)')))}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
STORY_OF = f"{_NT} AS norm, substr(sha1({_NT} || '|' || strftime(coalesce(published, processed_at), '%Y-%m-%d')), 1, 16) AS story"
STORY = f"{A}, story AS (SELECT *, {STORY_OF} FROM article)"
_CLUSTERS = f"""{SCORED}, story AS (SELECT *, {STORY_OF} FROM scored), clusters AS (
    SELECT channel, story, arg_max(link, (row_ord % 7 = 0, relevance_score, coalesce(epoch(published), 0), NOT regexp_matches(lower(source_id), '^(reddit-|tip-)'), -row_ord)) AS primary_link,
           count(*) AS members, list(link ORDER BY lower(source_name), link) AS links FROM story GROUP BY channel, story), found AS (
    SELECT c.channel, c.story, primary_link, CAST(coalesce(epoch(s.published), 0) AS BIGINT) AS newest, s.relevance_score AS score, members,
           array_to_string(list_filter(links, lambda x: x <> primary_link), ',') AS siblings FROM clusters c JOIN scored s ON s.link = primary_link)"""


def vector_topk(spark, sf_dir):
    return S.vector_top(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0, 20)


def label_centroid_argmax(spark, sf_dir):
    return S.nearest_centroid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def rail_counts(spark, sf_dir):
    """Unique articles per parent technique and per theme, with subtotals from one pass of grouping sets."""
    hits = matched(spark, sf_dir).select("link", F.inline("hits"))
    hits = hits.select("link", "theme", F.split_part("technique", F.lit("."), F.lit(1)).alias("parent")).distinct()
    return hits.groupingSets([[F.col("theme")], [F.col("parent")]], "theme", "parent").agg(F.count_distinct("link").alias("articles"))


def links_found(spark, sf_dir):
    return S.lookup(X.articles(spark, sf_dir), LINKS)[0].select("ask", "link", "title")


def links_missing(spark, sf_dir):
    return S.lookup(X.articles(spark, sf_dir), LINKS)[1]


LINKS = ["doc:7", "doc:none", "doc:3", "doc:12", "gone"]


def technique_union(spark, sf_dir):
    """Results of several techniques as one list, each article once, under the first technique that finds it."""
    wanted = ["PR001", "IF001", "MT002"]
    lists = [matched(spark, sf_dir).where(M.has_technique(t)).select("link", F.lit(i).alias("nth"), F.lit(t).alias("technique")) for i, t in enumerate(wanted)]
    all_of = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return all_of.groupBy("link").agg(F.min(F.struct("nth", "technique"))["technique"].alias("technique"))


def lane_union(spark, sf_dir):
    """Two lanes into one store: the first to bring a link keeps it; what both bring, and what one alone."""
    a, b = (X.articles(spark, sf_dir).where(c).select("link") for c in ("row_ord % 3 <> 0", "row_ord % 3 <> 1"))
    tag = lambda df, t: df.select("link", F.lit(t).alias("part"))
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "first")).unionByName(tag(b.exceptAll(a), "second"))


def trending_topics(spark, sf_dir):
    return S.trending(
        spark.read.parquet(f"{sf_dir}/events.parquet").select(
            F.col("event_type").alias("key"), F.col("user_id").alias("story"), F.col("ts").cast("timestamp").alias("stamp"), F.get_json_object("props", "$.k").alias("channel"), F.col("event_id").alias("row_ord")
        ),
        days=7,
        floor=2,
    )


def _topics(spark, sf_dir):
    """(kind, key) of each article: use cases, parent techniques, and matched aliases and framing terms of three characters or more."""
    rows = M.computed(scored(spark, sf_dir), {"low": F.lower("content")})
    terms = F.filter(F.array(*[F.when(T.has_alias(F.col("low"), t), F.lit(t.lower())) for t in X.FRAMING]), lambda t: t.isNotNull())
    rows = M.computed(rows, {"said": F.concat(terms, F.transform("hits", lambda h: F.lower(h["alias"]))), "story": T.story_key(F.col("title"), F.col("published"), F.col("processed_at"))})
    known = F.array(*[F.lit(x.lower()) for x in [t[1] for t in X.TAXONOMY] + [u[0] for u in X.USE_CASES]])
    parents = F.transform("hits", lambda h: F.split_part(h["technique"], F.lit("."), F.lit(1)))
    of = lambda kind, keys: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    said = F.filter("said", lambda t: (F.length(t) >= 3) & ~F.array_contains(known, t))
    keys = F.concat(of("use_case", F.col("use_cases")), of("technique", parents), of("term", said))
    return rows.select("row_ord", "story", "channel", F.coalesce("published", "processed_at").alias("stamp"), F.explode(keys).alias("key"))


def topics_trending(spark, sf_dir):
    """Stories of each use case, technique and term, recent against prior; two at least, for terms three."""
    anchor = X.articles(spark, sf_dir).agg(F.max("processed_at").alias("anchor"))
    found = S.trending(_topics(spark, sf_dir), days=7, floor=F.when(F.col("key.kind") == "term", 3).otherwise(2), anchor=anchor)
    return found.select("key.kind", "key.key", *[c for c in found.columns if c != "key"])


def trending_page(spark, sf_dir):
    """The first eight topics: most recent stories, most stories, name."""
    page = topics_trending(spark, sf_dir).orderBy(F.desc("recent"), F.desc("stories"), "key", "kind").limit(8)
    return page.select("kind", "key", "stories", "recent")


QUERIES = {
    f.__name__: f
    for f in (
        technique_counts, technique_hits, cve_domain_extract, relevance_score, use_case_labels, insider_type, article_filters,
        technique_filter, technique_topics, lexicon_hits, control_filter, article_controls, source_counts, source_counts_merged, keyword_search_topk,
        keyword_search_boosted, hybrid_search_topk, article_stream, story_clusters, cluster_page, uncovered_stories,
        syndication_representative, vector_topk, label_centroid_argmax, rail_counts, links_found, links_missing, technique_union,
        lane_union, trending_topics, topics_trending, trending_page,
    )
}



def _keyword_sql(with_: str, table: str, query: str, blob: str, ids: str) -> str:
    found = lambda t: f"list_distinct(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9+._-]+'))"
    return f"""WITH {with_}, q AS (SELECT {found(f"'{query}'")} AS q), s AS (
        SELECT row_ord, link, list_intersect(q, {found(blob)}) AS hit, len(q) AS m, len(list_intersect(q, {found("title")})) AS in_title,
               {ids} AS named, contains(lower(title || ' ' || content), array_to_string(list_sort(q), ' ')) AS whole FROM {table}, q), r AS (
        SELECT row_ord, link, CASE WHEN len(hit) > 0 THEN least(len(hit)::DOUBLE / m + CASE WHEN in_title > 0 THEN 0.15::DOUBLE ELSE 0 END
            + CASE WHEN len(list_filter(hit, lambda x: starts_with(x, 'cve'))) > 0 THEN 0.2::DOUBLE ELSE 0 END
            + CASE WHEN len(list_intersect(hit, named)) > 0 THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) WHEN whole THEN 0.4::DOUBLE ELSE 0 END AS s FROM s)
        SELECT link, round_even(s, 4) AS score FROM r WHERE s > 0 ORDER BY s DESC, row_ord LIMIT 20"""


_FRAMES = ", ".join(f"CASE WHEN {T.has_alias_sql('low', t)} THEN '{t.lower()}' END" for t in X.FRAMING)
_KNOWN = ", ".join("'" + x.lower() + "'" for x in [t[1] for t in X.TAXONOMY] + [u[0] for u in X.USE_CASES])
_TOPICS = f"""{SCORED}, base AS (SELECT *, {STORY_OF}, coalesce(published, processed_at) AS stamp FROM scored),
  said AS (SELECT row_ord, unnest([{_FRAMES}]) AS key FROM low UNION SELECT row_ord, lower(alias) FROM hits),
  keys AS (SELECT row_ord, 'use_case' AS kind, unnest(use_cases) AS key FROM base UNION SELECT row_ord, 'technique', split_part(technique, '.', 1) FROM hits
    UNION SELECT row_ord, 'term', key FROM said WHERE length(key) >= 3 AND key NOT IN ({_KNOWN})),
  w AS (SELECT kind, key, row_ord, story, channel, stamp >= anchor - INTERVAL 7 DAY AS recent, stamp < anchor - INTERVAL 7 DAY AND stamp >= anchor - INTERVAL 14 DAY AS prior
    FROM keys JOIN base USING (row_ord), (SELECT max(processed_at) AS anchor FROM article)),
  m AS (SELECT kind, key, channel FROM (SELECT kind, key, channel, count(*) AS n, min(row_ord) AS first FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY n DESC, first) = 1),
  t AS (SELECT kind, key, count(DISTINCT story) AS stories, count(DISTINCT story) FILTER (recent) AS recent, count(DISTINCT story) FILTER (prior) AS prior FROM w GROUP BY kind, key),
  topics AS (SELECT kind, key, stories, recent, prior, channel, CASE WHEN prior > 0 THEN round_even((recent - prior) * 100.0::DOUBLE / prior, 1) END AS delta_pct,
      CASE WHEN prior = 0 AND recent > 0 THEN 'new' WHEN recent > prior THEN 'up' WHEN recent < prior THEN 'down' ELSE 'flat' END AS direction
    FROM t JOIN m USING (kind, key) WHERE stories >= CASE WHEN kind = 'term' THEN 3 ELSE 2 END)"""
_has = lambda t: f"(technique = '{t}' OR starts_with(technique, '{t}.'))"
_BLOB = "blob AS (SELECT *, lower(title || ' ' || summary || ' ' || content) AS blob FROM article)"
_topic = lambda t: "(" + " OR ".join(T.has_alias_sql("blob", p.strip()) for p in [t[1], *t[3]] if len(p.strip()) >= 3) + ")"
ORACLE_SQL = {
    "technique_counts": f"WITH {HITS}, {TAX}, ids AS (SELECT DISTINCT row_ord, technique FROM hits UNION SELECT row_ord, split_part(technique, '.', 1) FROM hits) SELECT t.technique, t.title, t.theme, count(i.row_ord) AS articles FROM taxonomy t LEFT JOIN ids i USING (technique) GROUP BY ALL",
    "technique_hits": f"WITH {HITS} SELECT row_ord, technique, theme, alias FROM hits",
    "cve_domain_extract": f"""WITH {A}, b AS (SELECT link, summary || ' ' || content AS t FROM article), f AS (
        SELECT link, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(t), 'CVE-[0-9]{{4}}-[0-9]{{4,7}}'))), ',') AS cves,
               array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(t), '\\b(?:[a-z0-9-]+\\.)+(?:com|org|net)\\b')), lambda x: x <> 'example.org')), ',') AS domains FROM b)
        SELECT * FROM f WHERE cves <> '' OR domains <> ''""",
    "relevance_score": f"WITH {SCORED} SELECT link, relevance_score, alignment FROM scored",
    "use_case_labels": f"WITH {SCORED} SELECT link, array_to_string(use_cases, ',') AS use_cases FROM scored",
    "insider_type": f"WITH {SCORED} SELECT link, insider_type FROM scored",
    "article_filters": f"""WITH {SCORED} SELECT link, channel, relevance_score, insider_type FROM scored
        WHERE (relevance_score >= 0.2 OR channel = 'publications') AND alignment = 'insider' AND insider_type IS NOT NULL
          AND list_contains(use_cases, 'staff-conduct') AND source_id <> 'src1'""",
    "technique_filter": f"""WITH {HITS}, {_BLOB} SELECT link, title FROM blob WHERE row_ord IN (SELECT row_ord FROM hits WHERE {_has('PR001')} OR {_has('IF001')})
        OR {" OR ".join(_topic(t) for t in X.TAXONOMY if t[0] in ("PR001", "IF001"))}""",
    "technique_topics": f"WITH {A}, {_BLOB} " + " UNION ALL ".join(f"SELECT row_ord, '{t[0]}' AS technique FROM blob WHERE {_topic(t)}" for t in X.TAXONOMY),
    "lexicon_hits": f"""WITH {A}, w AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM benchmark),
        p AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        runs AS (SELECT 'B' || item_id AS technique, array_to_string(w[i:i + n - 1], ' ') AS alias, min(i) AS nth FROM p, (VALUES (1), (2), (3)) t(n) WHERE i + n - 1 <= len(w) GROUP BY 1, 2),
        names AS (SELECT DISTINCT alias FROM runs WHERE length(alias) >= 3),
        low AS (SELECT row_ord, lower(content) AS low, ' ' || regexp_replace(lower(content), '[^a-z0-9]', ' ', 'g') || ' ' AS spaced FROM article),
        found AS (SELECT row_ord, alias FROM low, names WHERE CASE WHEN length(alias) >= 8 OR contains(alias, ' ') THEN contains(low, alias) ELSE contains(spaced, ' ' || alias || ' ') END)
        SELECT row_ord, technique, arg_max(alias, (length(alias), -nth)) AS alias FROM found JOIN runs USING (alias) GROUP BY row_ord, technique""",
    "control_filter": f"WITH {HITS} SELECT row_ord, link FROM article WHERE row_ord IN (SELECT row_ord FROM hits WHERE technique IN ('IF001.001', 'IF002') OR starts_with(technique, 'IF002.'))",
    "article_controls": f"""WITH {HITS}, {X.values_sql("controls", "control, kind, technique", [(c, k, t) for c, k, ts in X.CONTROLS for t in ts])}
        SELECT link, coalesce(string_agg(DISTINCT control, ',' ORDER BY control) FILTER (kind = 'detection'), '') AS detections,
               coalesce(string_agg(DISTINCT control, ',' ORDER BY control) FILTER (kind = 'prevention'), '') AS preventions
        FROM hits JOIN controls USING (technique) GROUP BY link""",
    "source_counts": f"WITH {A} SELECT source_id, count(*) AS articles, arg_max(source_name, row_ord) FILTER (source_name <> '') AS name FROM article GROUP BY source_id",
    "source_counts_merged": f"""WITH {A}, {X.values_sql("conf", "source_id, configured", REGISTRY)}, n AS (SELECT source_id, count(*) AS articles, arg_max(source_name, row_ord) FILTER (source_name <> '') AS name FROM article GROUP BY source_id)
        SELECT source_id, coalesce(configured, name, source_id) AS name, coalesce(articles, 0) AS articles FROM n FULL OUTER JOIN conf USING (source_id)""",
    "keyword_search_topk": _keyword_sql(A, "article", QUERY, "title || ' ' || summary || ' ' || content", "[]"),
    "keyword_search_boosted": _keyword_sql(
        f"{HITS}, named AS (SELECT row_ord, list(technique) AS ids FROM hits GROUP BY row_ord), asked AS (SELECT a.*, coalesce(ids, []) AS ids FROM article a LEFT JOIN named USING (row_ord))",
        "asked", BOOSTED, "title || ' ' || concat_ws(' ', summary, nullif(array_to_string(ids, ' '), '')) || ' ' || content", "list_transform(ids, lambda x: lower(x))",
    ),
    "article_stream": f"WITH {A} SELECT link, title, CAST(epoch(published) AS BIGINT) AS published_s FROM article WHERE channel = 'news' ORDER BY published DESC NULLS LAST, row_ord LIMIT 50",
    "story_clusters": f"WITH {_CLUSTERS} SELECT * FROM found",
    "cluster_page": f"WITH {_CLUSTERS} SELECT story, channel, primary_link FROM found ORDER BY newest DESC, score DESC, story, channel LIMIT 25",
    "uncovered_stories": f"WITH {STORY} SELECT link, story FROM story WHERE row_ord % 7 <> 0 AND story NOT IN (SELECT story FROM story WHERE row_ord % 7 = 0 AND norm <> '')",
    "syndication_representative": f"""WITH {STORY} SELECT story, link FROM story QUALIFY row_number() OVER (PARTITION BY story, CASE WHEN norm = '' THEN row_ord END
        ORDER BY channel = 'filings' DESC, published DESC NULLS LAST, row_ord) = 1""",
    "vector_topk": """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (
        SELECT vec_id, round_even(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])), 6) AS cosine FROM embeddings, q WHERE vec_id <> 0)
        SELECT * FROM s ORDER BY cosine DESC, vec_id LIMIT 20""",
    "label_centroid_argmax": """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
        c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM c GROUP BY label),
        d AS (SELECT vec_id, c.label, sum(x * m) / any_value(norm) AS s FROM e JOIN c USING (i) JOIN n ON n.label = c.label GROUP BY vec_id, c.label)
        SELECT vec_id, arg_max(label, (round_even(s, 9), -label)) AS nearest FROM d GROUP BY vec_id""",
    "rail_counts": f"""WITH {HITS}, h AS (SELECT link, theme, split_part(technique, '.', 1) AS parent FROM hits)
        SELECT theme, parent, count(DISTINCT link) AS articles FROM h GROUP BY GROUPING SETS ((theme), (parent))""",
    "links_found": f"WITH {A}, {X.values_sql('asked', 'ask, link', list(enumerate(LINKS)))} SELECT ask, link, title FROM asked JOIN article USING (link)",
    "links_missing": f"WITH {A}, {X.values_sql('asked', 'ask, link', list(enumerate(LINKS)))} SELECT ask, link FROM asked WHERE link NOT IN (SELECT link FROM article)",
    "technique_union": f"""WITH {HITS}, f AS (SELECT link, CASE WHEN {_has("PR001")} THEN 0 WHEN {_has("IF001")} THEN 1 WHEN {_has("MT002")} THEN 2 END AS nth FROM hits)
        SELECT link, ['PR001', 'IF001', 'MT002'][min(nth) + 1] AS technique FROM f WHERE nth IS NOT NULL GROUP BY link""",
    "lane_union": f"""WITH {A}, l AS (SELECT link, row_ord % 3 <> 0 AS a, row_ord % 3 <> 1 AS b FROM article)
        SELECT link, CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' ELSE 'second' END AS part FROM l WHERE a OR b""",
    "topics_trending": f"WITH {_TOPICS} SELECT * FROM topics",
    "trending_page": f"WITH {_TOPICS} SELECT kind, key, stories, recent FROM topics ORDER BY recent DESC, stories DESC, key, kind LIMIT 8",
    "trending_topics": """WITH e AS (SELECT event_type AS key, user_id AS story, ts AS stamp, json_extract_string(props, '$.k') AS channel, event_id AS row_ord FROM events),
        a AS (SELECT max(stamp) AS anchor FROM e), w AS (SELECT *, stamp >= anchor - INTERVAL 7 DAY AS recent, stamp < anchor - INTERVAL 7 DAY AND stamp >= anchor - INTERVAL 14 DAY AS prior FROM e, a),
        m AS (SELECT key, channel FROM (SELECT key, channel, count(*) AS n, min(row_ord) AS first FROM w GROUP BY key, channel) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, first) = 1),
        t AS (SELECT key, count(DISTINCT story) AS stories, count(DISTINCT story) FILTER (recent) AS recent, count(DISTINCT story) FILTER (prior) AS prior FROM w GROUP BY key)
        SELECT key, stories, recent, prior, channel, CASE WHEN prior > 0 THEN round_even((recent - prior) * 100.0::DOUBLE / prior, 1) END AS delta_pct,
               CASE WHEN prior = 0 AND recent > 0 THEN 'new' WHEN recent > prior THEN 'up' WHEN recent < prior THEN 'down' ELSE 'flat' END AS direction
        FROM t JOIN m USING (key) WHERE stories >= 2""",
}

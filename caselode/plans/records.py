"""Queries of hits, stored texts, gates, follow-ups, lanes, social sources, details and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.operators import ledger as L
from caselode.operators import matching as M
from caselode.operators import records as R
from caselode.operators import vendors as V
from caselode.plans import casework as C
from caselode.plans import reading as G
from caselode.plans.nightly import EVENTS
from caselode.sources import fixtures as X

MODELS = {"model-0": "House model"}


def article_hits(spark, sf_dir):
    """Every article as a search hit; the model's id is made from its number."""
    n = F.col("row_ord") % 3
    model = F.when(n < 2, F.concat(F.lit("org/model-"), n.cast("string"), F.lit("-20240131"))).otherwise("")
    model = F.when(n == 0, "model-0").otherwise(model)
    return R.as_hits(G.scored(spark, sf_dir), model, MODELS)


def theme_filter(spark, sf_dir):
    return G.matched(spark, sf_dir).where(M.has_theme(" Motive ")).select("link")


def topic_filter(spark, sf_dir):
    """Articles whose text holds a technique's title or one of its aliases, whether or not it is a hit."""
    _, title, _, aliases = X.TAXONOMY[3]
    return X.articles(spark, sf_dir).where(M.has_topic(title, aliases)).select("link")


def full_text(spark, sf_dir):
    """Stored bodies for two articles in three, collapsed text for the others, without copyright lines."""
    a = X.articles(spark, sf_dir)
    clean = a.select("link", T.collapse(F.col("content")).alias("clean_text"))
    found = R.full_text(clean, a.where("row_ord % 3 <> 0").select("link", "content"), "Copyright")
    return found.select("link", F.sha2("text", 256).alias("sha"))


def spend_gate(spark, sf_dir):
    return _gate(spark, sf_dir, True)


def purchase_gate(spark, sf_dir):
    return _gate(spark, sf_dir, False)


def _gate(spark, sf_dir, body_needed):
    rows = G.scored(spark, sf_dir)
    gate = R.spend_gate(F.size("hits") > 0, F.col("alignment") == "insider", body_needed=body_needed)
    return rows.where(gate).select("link", "channel")


def follow_candidates(spark, sf_dir):
    n = F.col("row_ord")
    cases = X.cases(spark, sf_dir).withColumn("outcome", F.when(n % 5 == 0, "settled"))
    cases = cases.withColumn("docket", F.when(n % 4 != 3, n))
    state = cases.where(n % 3 == 0).select("link", (F.lit(1700000000) + n * 977 % 2_000_000).alias("polled_s"), (n % 11 == 0).alias("done"))
    return R.follow_candidates(cases, state, 1_702_000_000, 7)


def lane_states(spark, sf_dir):
    """Ten expected lanes, of which some bring nothing, beside lanes that are not expected."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 13 <> 4")
    lane = F.col("user_id") % 13
    results = e.select(
        lane.cast("long").alias("lane"),
        F.concat(F.lit("result "), lane.cast("string")).alias("name"),
        (F.col("event_type") == "purchase").alias("success"),
        F.when(lane % 5 == 0, 0).otherwise(1).cast("long").alias("fetched"),
        F.lit(1).cast("long").alias("saved"),
        F.when(F.col("event_id") % 997 == 5, F.concat(F.lit("HTTP 500 at "), F.col("event_id").cast("string"))).alias("error"),
    )
    expected = spark.createDataFrame([(i, f"lane {i}") for i in range(10)], "lane long, name string")
    previous = spark.createDataFrame([(i, i % 4) for i in range(0, 12, 2)], "lane long, failures long")
    return R.lane_states(expected, results.where("success or lane % 2 = 0"), previous)


SUGGESTED = [("reddit", "r/Src1", "licence-review", 1), ("reddit", "src1", "staff-conduct", 3), ("x", "@Src3", "cross-border", 2), ("x", "https://x.com/src3?s=1", None, 4), ("reddit", "Quiet", None, 5)]
SUBSCRIBED = [("reddit", "src1", True), ("x", "src9", False), ("x", "@SRC3", True)]


def social_sources(spark, sf_dir):
    counts = X.articles(spark, sf_dir).where("channel = 'social'").groupBy(F.concat(F.lit("reddit-"), "source_id").alias("source_id")).agg(F.count(F.lit(1)).alias("articles"))
    suggested = spark.createDataFrame(SUGGESTED, "platform string, handle string, use_case string, nth int")
    return R.social_sources(suggested, spark.createDataFrame(SUBSCRIBED, "platform string, handle string, enabled boolean"), counts)


def _logic(spark, sf_dir):
    """Each method's action as a hunt: the stack that sees it and what to look for."""
    m = X.methods(spark, sf_dir)
    strong = C._strong(spark, sf_dir).select("row_ord", "title", "strength")
    logic = F.concat(F.col("action"), F.lit(" in "), F.col("family"))
    return m.join(strong, "row_ord").select("technique", "row_ord", "m_pos", F.upper(F.coalesce("channel", F.lit("SIEM"))).alias("stack"), logic.alias("logic"), "title", "strength")


def technique_hunts(spark, sf_dir):
    """The first twelve different hunts of each technique."""
    rows = _logic(spark, sf_dir).withColumn("norm", F.lower(T.collapse(F.col("logic"))))
    return R.first_distinct(rows, "technique", "norm", ["row_ord", "m_pos"], 12).select("technique", "nth", "stack", "logic", F.substring("title", 1, 90).alias("case_title"))


def technique_terms(spark, sf_dir):
    """The first twenty different terms of each technique that are no names."""
    rows = _logic(spark, sf_dir).withColumn("term", F.initcap(F.split_part("logic", F.lit(" in "), F.lit(1))))
    rows = rows.withColumn("term", F.when(F.col("m_pos.l_linenumber") % 2 == 1, F.lower("term")).otherwise(F.col("term")))
    rows = rows.where(~T.is_entity_term(F.col("term"))).withColumn("norm", F.lower("term"))
    return R.first_distinct(rows, "technique", "norm", ["row_ord", "m_pos"], 20).select("technique", "nth", "term")


DETAIL = "PR001"


def technique_detail(spark, sf_dir):
    """One technique: occurrences by strength, its first eight record families; no row where no case has it."""
    uses = C._uses(spark, sf_dir).where(F.col("technique") == DETAIL)
    counts = L.technique_strength(uses)
    families = L.technique_families(uses, X.methods(spark, sf_dir), 8)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cases")).alias("n"), "record"))), lambda r: r["record"]), ";")
    both = counts.join(families.groupBy("technique").agg(names.alias("families")), "technique")
    strong = (F.col("adjudicated") + F.col("admitted")).alias("adjudicated_admitted")
    return both.select("technique", F.substring("technique", 1, 2).alias("theme"), "cases", strong, "alleged", "families")


def _pairs(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    n = F.col("doc_id")
    return labels.select(
        F.concat(F.lit("doc:"), "doc_id").alias("link"),
        F.when(n % 9 != 0, F.col("quality") == 1).alias("on_verdict"),
        F.when(n % 8 != 0, (F.col("quality") == 1) & (n % 7 != 0)).alias("off_verdict"),
        F.when(n % 3 == 0, n % 13 != 0).alias("on_verbatim"),
        F.when(n % 3 == 0, n % 11 != 0).alias("off_verbatim"),
        (n % 50 + 40).cast("double").alias("on_seconds"),
        (n % 30 + 20).cast("double").alias("off_seconds"),
    )


def _trial(spark, sf_dir):
    gold = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id % 2 = 0").select(F.concat(F.lit("doc:"), "doc_id").alias("link"), (F.col("quality") == 1).alias("verdict"))
    return R.trial_metrics(_pairs(spark, sf_dir), gold)


def trial_metrics(spark, sf_dir):
    return _trial(spark, sf_dir)


def trial_decision(spark, sf_dir):
    return R.trial_decision(_trial(spark, sf_dir))


def docket_updates(spark, sf_dir):
    """Conversations as dockets: turns that tell an outcome become one block at the end of the first turn's text."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    told = F.lower(F.coalesce("text", F.lit(""))).rlike("judgment|dismiss|settle|verdict|closed|the")
    entries = F.array_sort(F.collect_list(F.when((F.col("turn") > 0) & told, F.struct("turn", "text"))))
    by = turns.groupBy("conv_id").agg(F.min_by(F.coalesce("text", F.lit("")), "turn").alias("body"), entries.alias("entries"))
    done = R.docket_updates(F.col("body"), F.transform("entries", lambda e: e["text"]), F.lit("2024-05-01"))
    return by.select("conv_id", F.sha2(done, 256).alias("sha"))


def budget_split(spark, sf_dir):
    """A budget of 60, of which 15 are kept for older articles, which also get what the fresh ones leave."""
    rows = X.articles(spark, sf_dir).select("link", "row_ord", (F.col("row_ord") % 25 == 3).alias("fresh"))
    return R.reserve_split(rows, ["row_ord"], 60, 15)


def hunt_map(spark, sf_dir):
    counts = G.technique_counts(spark, sf_dir).select("technique", "articles")
    return R.hunt_map(X.taxonomy(spark).select("technique", "title", "aliases"), counts, "licence abuse")


def tool_table(spark, sf_dir):
    """Vendors of the categories that the text "m" finds, court cases only, in the order of the table."""
    counts = V.mention_counts(V.mentions(C._parts(spark, sf_dir), C.VENDORS))
    return R.tool_table(counts, "m", True).select("category", "vendor", "total", "verdict_true", "place")


def context_stories(spark, sf_dir):
    """Stories all of whose articles are weak: context, not cases."""
    rows = G._keyed(G.scored(spark, sf_dir).select("link", "title", "published", "processed_at", "alignment"))
    by = rows.groupBy("story").agg(F.every(F.col("alignment") == "weak").alias("context"), F.count(F.lit(1)).alias("members"))
    return by.where("context").select("story", "members")


def observed_detections(spark, sf_dir):
    """All detections of the techniques that articles have, each once."""
    ids = G.matched(spark, sf_dir).select(F.explode("hits").alias("h")).select(F.col("h.technique").alias("technique")).distinct()
    return ids.join(F.broadcast(X.controls(spark).where("kind = 'detection'")), "technique").select("control").distinct()


def technique_hit_counts(spark, sf_dir):
    """Hits of each technique without roll-up, with the last title that is not blank."""
    hits = G.matched(spark, sf_dir).select("row_ord", F.inline("hits"))
    named = F.when(F.trim("title") != "", F.struct("row_ord", "title"))
    return hits.groupBy("technique").agg(F.count(F.lit(1)).alias("hits"), F.max(named)["title"].alias("title"))


def watch_queries(spark, sf_dir):
    companies = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("company"))
    topics = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("query"))
    return R.watch_queries(companies, topics, "employee AND data")


def example_picks(spark, sf_dir):
    return R.example_picks(G.scored(spark, sf_dir)).select("link")


def share_bars(spark, sf_dir):
    """The share of adjudicated uses of each technique, half to even."""
    counts = L.technique_strength(C._uses(spark, sf_dir))
    return counts.select("technique", F.bround(100.0 * F.col("adjudicated") / F.col("cases"), 0).cast("int").alias("share"))


def unfinished_pairs(spark, sf_dir):
    links = X.articles(spark, sf_dir).select("link", "row_ord")
    done = links.where("row_ord % 3 = 0").select("link", F.lit("on").alias("arm")).unionByName(links.where("row_ord % 6 = 0").select("link", F.lit("off").alias("arm")))
    return R.unfinished(links.select("link"), done, "7")


def text_upgrades(spark, sf_dir):
    """Articles whose content may replace a stored text of a third, or of two thirds, of it."""
    part = F.when(F.col("row_ord") % 2 == 0, 3).otherwise(1.5)
    old = F.left("content", (F.length("content") / part).cast("int"))
    return X.articles(spark, sf_dir).where(R.text_upgrade(old, F.col("content"))).select("link")


def json_rescue(spark, sf_dir):
    """The properties of events, found again in a chatty text."""
    text = F.concat(F.lit("Sure, here it is: "), "props", F.lit(" - done."))
    k = F.try_variant_get(R.rescued_json(text), "$.k", "int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


PACKS = [("licence", ["IF001", "IF001.001"], ["license"]), ("prepare", ["PR001"], []), ("media", ["AF002"], ["usb", "the"])]


def picked_packs(spark, sf_dir):
    packs = spark.createDataFrame(PACKS, "pack string, anchors array<string>, hints array<string>")
    rows = G.matched(spark, sf_dir).select("link", "title", F.transform("hits", lambda h: h["technique"]).alias("ids"))
    return R.picked_packs(rows, packs)


def preview_trim(spark, sf_dir):
    """The newest 40 articles with at most 200 characters of text."""
    rows = X.articles(spark, sf_dir).orderBy(F.desc_nulls_last("published"), "row_ord").limit(40)
    return rows.select("link", F.left("content", F.lit(200)).alias("content"))


def due_lanes(spark, sf_dir):
    """Lanes whose last event is at least 12 hours before the newest of all."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 50).alias("lane"), F.col("ts").cast("timestamp").alias("ts"))
    last, now = e.groupBy("lane").agg(F.max("ts").alias("last")), e.agg(F.max("ts").alias("now"))
    return last.crossJoin(F.broadcast(now)).where(F.col("now") - F.col("last") >= F.expr("interval 12 hours")).select("lane")  # one row


def page_urls(spark, sf_dir):
    """Public addresses of techniques by their ids."""
    ids = G.matched(spark, sf_dir).select(F.explode("hits").alias("h")).select(F.col("h.technique").alias("technique")).distinct()
    return ids.select("technique", F.concat(F.lit("https://catalog.example/technique/"), F.lower(F.replace("technique", F.lit("."), F.lit("/")))).alias("url"))


QUERIES = {
    f.__name__: f
    for f in (
        article_hits, theme_filter, topic_filter, full_text, spend_gate, purchase_gate, follow_candidates, lane_states, social_sources,
        technique_hunts, technique_terms, technique_detail, trial_metrics, trial_decision, docket_updates, budget_split, hunt_map,
        tool_table, context_stories, observed_detections, technique_hit_counts, watch_queries, example_picks, share_bars, unfinished_pairs, text_upgrades,
        json_rescue, picked_packs, preview_trim, due_lanes, page_urls,
    )
}

_A = X.ARTICLE_SQL
_NAMED = f"{G.SCORED}, named AS (SELECT row_ord, string_agg(technique, ',' ORDER BY theme, technique) AS techniques FROM hits GROUP BY row_ord)"
_LOGIC = f"""{C.STRONG.removeprefix("WITH ")}, logic AS (SELECT m.technique, m.row_ord, m.m_pos, upper(coalesce(m.channel, 'SIEM')) AS stack, m.action || ' in ' || m.family AS logic, s.title
  FROM methods m JOIN strong s USING (row_ord))"""
_ENTITY = f"""(trim(term) = '' OR contains(term, '@') OR regexp_matches(lower(term), ' ({"|".join(T.COMPANY_WORDS)})( |$)') OR regexp_matches(lower(term), '^({"|".join(T.COMPANY_WORDS)}) ')
  OR (len(string_split(term, ' ')) >= 2 AND len(list_filter(string_split(term, ' '), lambda w: regexp_matches(w, '^[A-Z]'))) >= 0.6 * len(list_filter(string_split(term, ' '), lambda w: regexp_matches(w, '^[A-Za-z]')))
      AND len(list_filter(string_split(term, ' '), lambda w: regexp_matches(w, '^[A-Za-z]'))) > 0))"""
_FIRST = lambda cap: f"QUALIFY row_number() OVER (PARTITION BY technique ORDER BY row_ord, m_pos) <= {cap}"
_GATE = lambda other: f"""WITH {G.SCORED}, g AS (SELECT s.*, EXISTS (SELECT 1 FROM hits h WHERE h.row_ord = s.row_ord) AS hit, alignment = 'insider' AS framed FROM scored s),
  b AS (SELECT *, length(trim(content)) >= 1500 AND (len(use_cases) > 0 OR framed OR hit) AS bodied FROM g)
  SELECT link, channel FROM b WHERE {other}"""  # noqa: E731
_OTHER = "((len(use_cases) > 0 AND channel <> 'news') OR (hit AND framed) OR (channel = 'filings' AND bodied))"
_TRIAL = """p AS (SELECT doc_id AS n, CASE WHEN doc_id % 9 <> 0 THEN quality = 1 END AS on_v, CASE WHEN doc_id % 8 <> 0 THEN quality = 1 AND doc_id % 7 <> 0 END AS off_v,
    CASE WHEN doc_id % 3 = 0 THEN doc_id % 13 <> 0 END AS on_q, CASE WHEN doc_id % 3 = 0 THEN doc_id % 11 <> 0 END AS off_q, CASE WHEN doc_id % 2 = 0 THEN quality = 1 END AS gold FROM labels),
  m AS (SELECT count(*) AS pairs, round_even(avg((on_v = off_v)::INTEGER), 4) AS arms_agree,
    round_even(avg((on_v IS NULL)::INTEGER), 4) AS on_unparsed, round_even(avg((on_v = gold)::INTEGER), 4) AS on_agreement, round_even(avg(on_q::INTEGER), 4) AS on_verbatim,
    round_even(avg((off_v IS NULL)::INTEGER), 4) AS off_unparsed, round_even(avg((off_v = gold)::INTEGER), 4) AS off_agreement, round_even(avg(off_q::INTEGER), 4) AS off_verbatim,
    round_even(avg(CASE WHEN on_v IS NOT NULL AND off_v IS NOT NULL THEN n % 50 + 40 END) / avg(CASE WHEN on_v IS NOT NULL AND off_v IS NOT NULL THEN n % 30 + 20 END), 3) AS speedup FROM p)"""
_Q = "licence abuse"
ORACLE_SQL = {
    "article_hits": f"""WITH {_NAMED} SELECT s.link, s.title, s.channel, substr(sha1({G._NT} || '|' || strftime(coalesce(published, processed_at), '%Y-%m-%d')), 1, 16) AS story,
        round_even(relevance_score, 4) AS score, alignment, coalesce(techniques, '') AS techniques, array_to_string(use_cases, ',') AS use_cases,
        CASE row_ord % 3 WHEN 0 THEN 'House model' WHEN 1 THEN 'Model 1' END AS enriched_by FROM scored s LEFT JOIN named USING (row_ord)""",
    "theme_filter": f"WITH {G.HITS} SELECT link FROM article WHERE row_ord IN (SELECT row_ord FROM hits WHERE theme = 'motive')",
    "topic_filter": f"""WITH {_A}, t AS (SELECT link, lower(title || ' ' || summary || ' ' || content) AS low FROM article)
        SELECT link FROM t WHERE {" OR ".join(T.has_alias_sql("low", p) for p in [X.TAXONOMY[3][1], *X.TAXONOMY[3][3]])}""",
    "full_text": f"""WITH {_A}, b AS (SELECT link, CASE WHEN row_ord % 3 <> 0 AND content <> '' THEN content ELSE trim(regexp_replace(content, '\\s+', ' ', 'g')) END AS body FROM article)
        SELECT link, sha256(regexp_replace(array_to_string(list_filter(string_split(body, chr(10)), lambda x: NOT starts_with(ltrim(x), 'Copyright')), chr(10)), '^\\s+|\\s+$', '', 'g')) AS sha FROM b""",
    "spend_gate": _GATE(f"CASE WHEN channel = 'filings' THEN bodied ELSE {_OTHER} END"),
    "purchase_gate": _GATE(_OTHER),
    "follow_candidates": f"""WITH {X.CASES_SQL}, s AS (SELECT *, CASE WHEN row_ord % 3 = 0 THEN 1700000000 + row_ord * 977 % 2000000 END AS polled_s FROM cases)
        SELECT link, row_ord AS docket, coalesce(polled_s, 0) AS turn FROM s WHERE verdict IS TRUE AND row_ord % 5 <> 0 AND row_ord % 4 <> 3
          AND NOT (row_ord % 3 = 0 AND row_ord % 11 = 0) AND (polled_s IS NULL OR 1702000000 - polled_s >= 604800)""",
    "lane_states": f"""WITH {EVENTS}, r AS (SELECT user_id % 13 AS lane, event_type = 'purchase' AS success, CASE WHEN user_id % 13 % 5 = 0 THEN 0 ELSE 1 END AS fetched,
            CASE WHEN event_id % 997 = 5 THEN 'HTTP 500 at ' || event_id END AS error FROM e WHERE user_id % 13 <> 4),
        got AS (SELECT lane, bool_or(success) AS success, CAST(sum(fetched) AS BIGINT) AS fetched, count(*) AS saved, coalesce(string_agg(error, '; ' ORDER BY error), '') AS errors FROM r WHERE success OR lane % 2 = 0 GROUP BY lane),
        x AS (SELECT range AS lane, 'lane ' || range AS name FROM range(10)), p AS (SELECT range AS lane, range % 4 AS failures FROM range(0, 12, 2)),
        o AS (SELECT lane, coalesce('result ' || got.lane, x.name) AS name, CASE WHEN success IS NULL THEN 'skipped' WHEN success THEN CASE WHEN fetched > 0 THEN 'ok' ELSE 'empty' END
            WHEN contains(lower(errors), 'http ') THEN 'http_error' ELSE 'error' END AS outcome, errors, fetched, saved, coalesce(failures, 0) AS before, success FROM x FULL OUTER JOIN got USING (lane) LEFT JOIN p USING (lane)),
        f AS (SELECT *, CASE WHEN outcome = 'skipped' THEN before WHEN outcome <> 'ok' THEN before + 1 ELSE 0 END AS failures FROM o)
        SELECT lane, name, outcome, CASE WHEN outcome NOT IN ('ok', 'skipped') AND errors <> '' THEN errors END AS error, coalesce(fetched, 0) AS fetched, coalesce(saved, 0) AS saved, failures, failures >= 3 AS broken FROM f""",
    "social_sources": f"""WITH {_A}, n AS (SELECT 'reddit-' || source_id AS source_id, count(*) AS articles FROM article WHERE channel = 'social' GROUP BY 1),
        c(platform, id, use_cases, subscribed) AS (VALUES ('reddit', 'src1', 'licence-review,staff-conduct', true), ('x', 'src3', 'cross-border', true), ('reddit', 'quiet', '', false), ('x', 'src9', '', false))
        SELECT platform, id, platform || '-' || id AS source_id, use_cases, subscribed, coalesce(articles, 0) AS articles FROM c LEFT JOIN n ON n.source_id = platform || '-' || id""",
    "technique_hunts": f"""WITH {_LOGIC}, f AS (SELECT * FROM logic QUALIFY row_number() OVER (PARTITION BY technique, lower(logic) ORDER BY row_ord, m_pos) = 1)
        SELECT technique, row_number() OVER (PARTITION BY technique ORDER BY row_ord, m_pos) AS nth, stack, logic, substr(title, 1, 90) AS case_title FROM f {_FIRST(12)}""",
    "technique_terms": f"""WITH {_LOGIC}, i AS (SELECT *, split_part(logic, ' in ', 1) AS w FROM logic),
        t AS (SELECT *, CASE WHEN m_pos[1] % 2 = 1 THEN lower(w) ELSE array_to_string(list_transform(string_split(w, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS term FROM i),
        f AS (SELECT * FROM t WHERE NOT {_ENTITY} QUALIFY row_number() OVER (PARTITION BY technique, lower(term) ORDER BY row_ord, m_pos) = 1)
        SELECT technique, row_number() OVER (PARTITION BY technique ORDER BY row_ord, m_pos) AS nth, term FROM f {_FIRST(20)}""",
    "technique_detail": f"""{C.STRONG}, u AS (SELECT * FROM uses WHERE technique = '{DETAIL}'), k AS (SELECT row_ord, family AS record FROM methods GROUP BY 1, 2),
        n AS (SELECT record, count(*) AS n FROM u JOIN k USING (row_ord) GROUP BY record ORDER BY n DESC, record LIMIT 8)
        SELECT '{DETAIL}' AS technique, '{DETAIL[:2]}' AS theme, count(*) AS cases, count(*) FILTER (strength IN ('adjudicated', 'admitted')) AS adjudicated_admitted,
               count(*) FILTER (strength = 'alleged') AS alleged, (SELECT string_agg(record, ';' ORDER BY n DESC, record) FROM n) AS families FROM u HAVING count(*) > 0""",
    "trial_metrics": f"WITH {_TRIAL} SELECT * FROM m",
    "trial_decision": f"""WITH {_TRIAL} SELECT 'unparsed' AS criterion, coalesce(off_unparsed <= on_unparsed, false) AS passed FROM m
        UNION ALL SELECT 'agreement', CASE WHEN on_agreement IS NULL AND off_agreement IS NULL THEN true ELSE coalesce(off_agreement >= round_even(0.95::DOUBLE * coalesce(on_agreement, 0), 4), false) END FROM m
        UNION ALL SELECT 'verbatim_floor', coalesce(on_verbatim >= 0.85::DOUBLE, true) FROM m
        UNION ALL SELECT 'verbatim_drop', coalesce(off_verbatim >= round_even(on_verbatim - 0.05::DOUBLE, 4), true) FROM m
        UNION ALL SELECT 'speedup', coalesce(speedup >= 1.5::DOUBLE, false) FROM m""",
    "docket_updates": """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), b AS (SELECT conv_id, arg_min(text, turn) AS body FROM c GROUP BY conv_id),
        n AS (SELECT conv_id, '- ' || substr(text, 1, 300) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM c WHERE turn > 0 AND regexp_matches(lower(text), 'judgment|dismiss|settle|verdict|closed|the')),
        u AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY nth) AS lines FROM n WHERE nth <= 12 GROUP BY conv_id)
        SELECT conv_id, sha256(body || CASE WHEN lines IS NULL THEN '' ELSE chr(10) || '=== UPDATES as of 2024-05-01 ===' || chr(10) || lines END) AS sha FROM b LEFT JOIN u USING (conv_id)""",
    "budget_split": f"""WITH {_A}, n AS (SELECT link, row_ord % 25 = 3 AS fresh, row_number() OVER (PARTITION BY row_ord % 25 = 3 ORDER BY row_ord) AS nth FROM article),
        s AS (SELECT count(*) AS spent FROM n WHERE fresh AND nth <= 45)
        SELECT link, CASE WHEN fresh THEN 'batch' ELSE 'backfill' END AS part, nth FROM n, s WHERE CASE WHEN fresh THEN nth <= 45 ELSE nth <= 60 - spent END""",
    "hunt_map": f"""WITH {G.HITS}, {X.values_sql("tax", "technique, title, aliases", [(t, n, "|".join(a)) for t, n, _, a in X.TAXONOMY])},
        ids AS (SELECT DISTINCT row_ord, technique FROM hits UNION SELECT row_ord, split_part(technique, '.', 1) FROM hits), c AS (SELECT technique, count(*) AS articles FROM ids WHERE technique IN (SELECT technique FROM tax) GROUP BY technique),
        p AS (SELECT technique, title, list_filter(string_split(aliases, '|'), lambda a: contains(lower(a), '{_Q}') OR (length(a) >= 3 AND contains('{_Q}', lower(a)))) AS part, list_contains(string_split(lower(aliases), '|'), '{_Q}') AS named FROM tax),
        m AS (SELECT technique, title, CASE WHEN lower(technique) = '{_Q}' THEN 100 WHEN named THEN 92 WHEN lower(title) = '{_Q}' THEN 88 WHEN len(part) > 0 THEN 55 + least(list_max(list_transform(part, lambda a: length(a))), 25)
            WHEN contains(lower(title), '{_Q}') OR contains(lower(technique), '{_Q}') THEN 40 ELSE 0 END AS match FROM p)
        SELECT technique, title, CAST(CASE WHEN match > 0 THEN match ELSE 10 + articles END AS BIGINT) AS score, coalesce(articles, 0) AS articles, match > 0 AS from_catalog FROM m LEFT JOIN c USING (technique) WHERE match > 0 OR articles IS NOT NULL""",
    "tool_table": f"""WITH {C._MENTIONS}, n AS (SELECT category, vendor, count(DISTINCT link) AS total, count(DISTINCT link) FILTER (verdict) AS verdict_true FROM mentions GROUP BY category, vendor)
        SELECT *, row_number() OVER (PARTITION BY category ORDER BY total > 0 DESC, verdict_true DESC, total DESC, lower(vendor)) AS place FROM n WHERE contains(lower(category), 'm') OR contains(lower(vendor), 'm')""",
    "context_stories": f"WITH {G.SCORED}, story AS (SELECT *, {G.STORY_OF} FROM scored) SELECT story, count(*) AS members FROM story GROUP BY story HAVING bool_and(alignment = 'weak')",
    "observed_detections": f"""WITH {G.HITS}, {X.values_sql("controls", "control, kind, technique", [(c, k, t) for c, k, ts in X.CONTROLS for t in ts])}
        SELECT DISTINCT control FROM hits JOIN controls USING (technique) WHERE kind = 'detection'""",
    "technique_hit_counts": f"WITH {G.HITS} SELECT technique, count(*) AS hits, any_value(title) AS title FROM hits GROUP BY technique",
    "watch_queries": """SELECT trim(n_name) AS query FROM nation WHERE trim(n_name) <> '' UNION SELECT '"' || trim(s_name) || '" (employee AND data)' FROM supplier WHERE trim(s_name) <> '' UNION SELECT '"' || trim(s_name) || '"' FROM supplier WHERE trim(s_name) <> ''""",
    "example_picks": f"WITH {G.SCORED} SELECT link FROM scored s ORDER BY (SELECT count(*) FROM hits h WHERE h.row_ord = s.row_ord) * 1000 + relevance_score DESC, link LIMIT 3",
    "share_bars": f"{C.STRONG} SELECT technique, CAST(round_even(100.0::DOUBLE * count(*) FILTER (strength = 'adjudicated') / count(*), 0) AS INTEGER) AS share FROM uses GROUP BY technique",
    "unfinished_pairs": f"""WITH {_A} SELECT link, CASE WHEN strpos('02468ace', right(sha256('7:' || link), 1)) > 0 THEN 'on' ELSE 'off' END AS first_arm FROM article WHERE row_ord % 6 <> 0""",
    "text_upgrades": f"WITH {_A} SELECT link FROM article WHERE length(content) >= 5000 AND length(content) >= 2 * CAST(floor(length(content) / CASE WHEN row_ord % 2 = 0 THEN 3 ELSE 1.5 END) AS INTEGER)",
    "json_rescue": """WITH t AS (SELECT regexp_extract('Sure, here it is: ' || props || ' - done.', '(?s)\\{.*\\}') AS j FROM events)
        SELECT CASE WHEN json_valid(j) THEN CAST(json_extract_string(j, '$.k') AS INTEGER) END AS k, count(*) AS n FROM t GROUP BY 1""",
    "picked_packs": f"""WITH {G.HITS}, p(pack, technique) AS (VALUES ('licence', 'IF001'), ('licence', 'IF001.001'), ('prepare', 'PR001'), ('media', 'AF002'))
        SELECT link, pack FROM hits JOIN p USING (technique) UNION SELECT link, 'licence' FROM article WHERE contains(lower(title), 'license') UNION SELECT link, 'media' FROM article WHERE contains(lower(title), 'usb') OR contains(lower(title), 'the')""",
    "preview_trim": f"WITH {_A} SELECT link, substr(content, 1, 200) AS content FROM article ORDER BY published DESC NULLS LAST, row_ord LIMIT 40",
    "due_lanes": f"WITH {EVENTS} SELECT user_id % 50 AS lane FROM e GROUP BY 1 HAVING max(ts) <= (SELECT max(ts) FROM e) - INTERVAL 12 HOUR",
    "page_urls": f"WITH {G.HITS} SELECT DISTINCT technique, 'https://catalog.example/technique/' || lower(replace(technique, '.', '/')) AS url FROM hits",
}

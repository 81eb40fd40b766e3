"""Queries of feeds, runs, filings and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselode.functions import text as T
from caselode.operators import feeds as O
from caselode.operators import incremental as I
from caselode.operators import reports as R
from caselode.plans import nightly as N
from caselode.plans import reading as G
from caselode.plans.reports import _IDS, _esc
from caselode.plans.reports import ORACLE_SQL as _REPORTS
from caselode.sources import fixtures as X

ENVELOPE = {"title": "Casework & claims", "subtitle": "Flagged articles <newest first>", "self_url": "https://feeds.example/feed.xml?a=1&b=2", "home_url": "https://feeds.example"}


def atom_document(spark, sf_dir):
    """The feed of the fifty newest flagged articles: its stamp, its entries, and a digest of the document."""
    page = G.scored(spark, sf_dir).where("alignment = 'insider'").orderBy(F.desc_nulls_last("published"), "row_ord").limit(50)
    return O.atom_document(page, **ENVELOPE).select("updated", "entries", F.length("feed").alias("n"), F.sha2("feed", 256).alias("sha"))


def run_totals(spark, sf_dir):
    """Runs of seven lanes, an hour each, and all of them as one run."""
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    e = N._events(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("lane"), hour.alias("hour"))
    runs = e.agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("event_type") == "purchase").alias("saved"), F.min(F.unix_micros("ts")).alias("started"), F.max(F.unix_micros("ts")).alias("finished"))
    return O.run_totals(runs)


def filing_states(spark, sf_dir):
    """Filings by body, model and schema; models, schemas and purchases stand for what the test tables don't have."""
    r = F.col("row_ord")
    rows = X.articles(spark, sf_dir).withColumns({"model": F.when(r % 7 != 0, F.concat(F.lit("model-"), r % 3)), "schema": (r % 4).cast("int"), "bought": r % 6 == 0})
    return O.filing_states(rows, "model-2", 3).withColumn("newest", F.unix_timestamp("newest"))


def fresh_batch(spark, sf_dir):
    """What is new or changed, over all channels: filings first, then the newest, then the corpus order."""
    rows = X.articles(spark, sf_dir)
    todo = rows.where("row_ord % 5 = 0 or row_ord % 4 = 0").select("link", "row_ord", F.lit("all").alias("batch"), (F.col("channel") == "filings").alias("filing"), "published")
    return I.numbered(todo, "batch", [F.desc("filing"), F.desc_nulls_last("published"), F.col("row_ord").asc()]).select("link", "nth")


def technique_refs_merged(spark, sf_dir):
    """The lexicon's techniques and a model's that pass validation, as one list, with the controls of all of them."""
    table = F.array(*map(F.lit, [*_IDS, "ZZ999"]))
    refs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.get(table, ((F.col("row_ord") * 3 + i * 5) % 11).cast("int")).alias("id"), (((F.col("row_ord") * 7 + i * 13) % 100) / F.lit(100.0)).alias("confidence")))
    lexical = F.transform("hits", lambda h: h["technique"])
    rows = G.matched(spark, sf_dir).select("link", F.concat(lexical, R.valid_refs(lexical, refs, _IDS)).alias("ids"))
    of = lambda kind: {t: sorted({c for c, k, ts in X.CONTROLS if k == kind and t in ts}) for t in _IDS}
    table_of = lambda kind: F.create_map(*[x for t, cs in of(kind).items() for x in (F.lit(t), F.array(*map(F.lit, cs)).cast("array<string>"))])
    pick = lambda kind: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("ids", lambda t: F.element_at(table_of(kind), t))))), ",")
    return rows.select("link", F.array_join("ids", ",").alias("ids"), pick("detection").alias("detections"), pick("prevention").alias("preventions"))


def search_terms(spark, sf_dir):
    """Terms of each article: a model's own (for one article in three), else aliases, framing terms, CVEs and domains."""
    low = F.lower("content")
    framed = F.filter(F.array(*[F.when(T.has_alias(low, t), F.lit(t)) for t in X.FRAMING]), lambda t: t.isNotNull())
    own = F.when(F.col("row_ord") % 3 == 0, F.array(F.lit("Trade Secret"), F.col("source_id"))).when(F.col("row_ord") % 3 == 1, F.array(F.lit("customer data")))
    both = F.concat_ws(" ", "summary", "content")
    terms = O.search_terms(own, [F.transform("hits", lambda h: h["alias"]), framed, T.cves(both), T.domains(both, X.TOP_LEVEL, X.SKIPPED)])
    return G.matched(spark, sf_dir).select("link", F.array_join(terms, "|").alias("terms"))


def newest_generation(spark, sf_dir):
    """The newest generation of each link, of equal dates the later one, undated ones last, with its richness; an outcome adds 15."""
    h = N._history(spark, sf_dir).withColumns({"made": F.when(F.col("gen") % 3 != 0, F.col("gen") - F.col("gen") % 2), "outcome": F.col("n_methods") > 2})
    rich = I.richness() + 15 * F.col("outcome").cast("int")
    best = F.struct(F.col("made").isNotNull().alias("dated"), "made", "gen")
    return h.groupBy("link").agg(F.max_by(F.struct("gen", rich.alias("rich")), best).alias("g")).select("link", "g.*")


QUERIES = {f.__name__: f for f in (atom_document, run_totals, filing_states, fresh_batch, technique_refs_merged, search_terms, newest_generation)}

_E = {k: v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for k, v in ENVELOPE.items()}
_FRAMED = ", ".join(f"CASE WHEN {T.has_alias_sql('low', t)} THEN '{t}' END" for t in X.FRAMING)
_VACUOUS = ", ".join(f"'{t}'" for t in O.VACUOUS_TERMS)
ORACLE_SQL = {
    "atom_document": f"""WITH e AS ({_REPORTS["atom_feed"]}), {X.ARTICLE_SQL}, r AS (SELECT entry, published, row_ord FROM e JOIN article USING (link)),
        d AS (SELECT strftime(coalesce(max(published), TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS updated, count(*) AS entries, coalesce(string_agg(entry || chr(10), '' ORDER BY published DESC NULLS LAST, row_ord), '') AS body FROM r),
        f AS (SELECT updated, entries, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<feed xmlns="http://www.w3.org/2005/Atom">' || chr(10) || '<title>{_E["title"]}</title>' || chr(10) || '<subtitle>{_E["subtitle"]}</subtitle>' || chr(10)
          || '<link rel="self" href="{_E["self_url"]}"/>' || chr(10) || '<link rel="alternate" href="{_E["home_url"]}"/>' || chr(10) || '<id>{_E["home_url"]}/feed.xml</id>' || chr(10) || '<updated>' || updated || '</updated>' || chr(10) || body || '</feed>' AS feed FROM d)
        SELECT updated, entries, CAST(length(feed) AS INTEGER) AS n, sha256(feed) AS sha FROM f""",
    "run_totals": f"""WITH {N.EVENTS}, r AS (SELECT user_id % 7 AS lane, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS fetched, count(*) FILTER (event_type = 'purchase') AS saved, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS finished FROM e GROUP BY 1, 2)
        SELECT lane, count(*) AS runs, CAST(coalesce(sum(fetched), 0) AS BIGINT) AS fetched, CAST(coalesce(sum(saved), 0) AS BIGINT) AS saved, min(started) AS started, max(finished) AS finished FROM r GROUP BY GROUPING SETS ((lane), ())""",
    "filing_states": f"""WITH {X.ARTICLE_SQL}, a AS (SELECT *, channel = 'filings' AS f, length(content) AS n, CASE WHEN row_ord % 7 <> 0 THEN 'model-' || (row_ord % 3) END AS model, row_ord % 4 AS schema, row_ord % 6 = 0 AS bought FROM article)
        SELECT count(*) AS total, CAST(epoch(max(processed_at)) AS BIGINT) AS newest, count(*) FILTER (f) AS filings, count(*) FILTER (f AND n >= 1500) AS with_body, count(*) FILTER (f AND n < 1500) AS stubs, count(*) FILTER (f AND n < 1500 AND bought) AS paid_stubs,
               count(*) FILTER (f AND model IS NULL) AS never_enriched, count(*) FILTER (f AND model <> 'model-2') AS stale_by_model, count(*) FILTER (f AND model = 'model-2' AND schema < 3) AS stale_by_schema, count(*) FILTER (f AND model = 'model-2' AND schema >= 3) AS "current" FROM a""",
    "fresh_batch": f"""WITH {X.ARTICLE_SQL} SELECT link, CAST(row_number() OVER (ORDER BY channel = 'filings' DESC, published DESC NULLS LAST, row_ord) AS INTEGER) AS nth FROM article WHERE row_ord % 5 = 0 OR row_ord % 4 = 0""",
    "technique_refs_merged": f"""WITH {G.HITS}, {X.values_sql("controls", "control, kind, technique", [(c, k, t) for c, k, ts in X.CONTROLS for t in ts])},
        r AS (SELECT row_ord, i, {[*_IDS, "ZZ999"]}[(row_ord * 3 + i * 5) % 11 + 1] AS id, (row_ord * 7 + i * 13) % 100 / 100.0::DOUBLE AS c FROM article, range(8) t(i)),
        k AS (SELECT row_ord, id, min(i) AS i FROM r WHERE c >= 0.6 AND id <> 'ZZ999' AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.row_ord = r.row_ord AND technique = id) GROUP BY row_ord, id QUALIFY row_number() OVER (PARTITION BY row_ord ORDER BY min(i)) <= 5),
        u AS (SELECT row_ord, technique AS id, row_number() OVER (PARTITION BY row_ord ORDER BY theme, technique) - 1000 AS o FROM hits UNION ALL SELECT row_ord, id, i FROM k),
        l AS (SELECT row_ord, string_agg(id, ',' ORDER BY o) AS ids FROM u GROUP BY row_ord),
        c AS (SELECT row_ord, string_agg(DISTINCT control, ',' ORDER BY control) FILTER (kind = 'detection') AS d, string_agg(DISTINCT control, ',' ORDER BY control) FILTER (kind = 'prevention') AS p FROM u JOIN controls ON technique = id GROUP BY row_ord)
        SELECT link, coalesce(ids, '') AS ids, coalesce(d, '') AS detections, coalesce(p, '') AS preventions FROM article LEFT JOIN l USING (row_ord) LEFT JOIN c USING (row_ord)""",
    "search_terms": f"""WITH {G.HITS}, al AS (SELECT row_ord, list(alias ORDER BY theme, technique) AS aliases FROM hits GROUP BY row_ord),
        t AS (SELECT l.row_ord, link, source_id, coalesce(aliases, []) AS aliases, list_filter([{_FRAMED}], lambda x: x IS NOT NULL) AS framed, upper(summary || ' ' || content) AS up, lower(summary || ' ' || content) AS lo FROM low l LEFT JOIN al USING (row_ord)),
        o AS (SELECT row_ord, link, CASE row_ord % 3 WHEN 0 THEN [source_id] ELSE [] END AS own, list_concat(aliases, framed, list_sort(list_distinct(regexp_extract_all(up, 'CVE-[0-9]{{4}}-[0-9]{{4,7}}'))),
                list_sort(list_filter(list_distinct(regexp_extract_all(lo, '\\b(?:[a-z0-9-]+\\.)+(?:com|org|net)\\b')), lambda x: x <> 'example.org'))) AS rest FROM t),
        p AS (SELECT row_ord, unnest(rest) AS term, generate_subscripts(rest, 1) AS i FROM o),
        q AS (SELECT row_ord, term, i FROM p WHERE length(trim(term)) >= 3 AND lower(trim(term)) NOT IN ({_VACUOUS}) AND NOT regexp_matches(trim(term), '^[A-Za-z]{{2}}[0-9]{{3}}([.][0-9]{{3}})?$') QUALIFY row_number() OVER (PARTITION BY row_ord, lower(term) ORDER BY i) = 1),
        s AS (SELECT row_ord, string_agg(term, '|' ORDER BY i) AS terms FROM q GROUP BY row_ord)
        SELECT link, CASE WHEN len(own) > 0 THEN own[1] ELSE coalesce(terms, '') END AS terms FROM o LEFT JOIN s USING (row_ord)""",
    "newest_generation": f"""WITH {N.HISTORY} SELECT link, gen, rich + 15 * CAST(n_methods > 2 AS INTEGER) AS rich FROM rich
        QUALIFY row_number() OVER (PARTITION BY link ORDER BY gen % 3 <> 0 DESC, CASE WHEN gen % 3 <> 0 THEN gen - gen % 2 END DESC NULLS LAST, gen DESC) = 1""",
}

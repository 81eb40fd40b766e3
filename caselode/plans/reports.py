"""Queries of candidates, reports, feeds and work lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from caselode.operators import ledger as L
from caselode.operators import reports as R
from caselode.operators.incremental import richness
from caselode.operators.search import Embedder
from caselode.plans import casework as C
from caselode.plans.nightly import HISTORY, _history
from caselode.plans.reading import A, HITS, SCORED, matched, scored
from caselode.sources import fixtures as X


def _records(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id > 2")
    strength = F.element_at(F.array(F.lit("weak"), F.lit("moderate"), F.lit("strong")), F.when(F.col("label") == 4, 1).otherwise(F.col("vec_id") % 3 + 1).cast("int"))
    return v.select(
        (F.col("label") * 40 + F.col("vec_id") % 40).alias("cluster"), F.col("vec_id").alias("id"), (F.col("vec_id") % 7).alias("story"), (F.col("vec_id") % 3).alias("domain"), strength.alias("strength"), F.col("embedding").alias("vector"), (F.col("vec_id") % 365).alias("seen")
    )


def novel_candidates(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id <= 2").select(F.concat(F.lit("T"), "vec_id").alias("technique"), F.col("embedding").alias("vector"))
    return R.candidate_rollup(_records(spark, sf_dir), known, 0.3)


def candidate_counts(spark, sf_dir):
    return novel_candidates(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("candidates"))


def llm_ref_merge(spark, sf_dir):
    """Proposed technique ids that pass validation, beside the lexicon's, in taxonomy order."""
    ids = [t[0] for t in X.TAXONOMY]
    table = F.array(*map(F.lit, [*ids, "ZZ999"]))
    refs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.get(table, ((F.col("row_ord") * 3 + i * 5) % 11).cast("int")).alias("id"), (((F.col("row_ord") * 7 + i * 13) % 100) / F.lit(100.0)).alias("confidence")))
    lexical = F.transform("hits", lambda h: h["technique"])
    return matched(spark, sf_dir).select("link", F.array_join(R.valid_refs(lexical, refs, ids), ",").alias("added"))


def technique_shortlist(spark, sf_dir):
    """Lexical techniques, filled up to five by similarity of the hashed embeddings; vectors in Arrow batches."""
    names = [t[0] for t in X.TAXONOMY]
    known = Embedder()([f"{t[1]} {' '.join(t[3])}" for t in X.TAXONOMY])

    @F.pandas_udf("array<double>")
    def similar(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = Embedder()
        for t in texts:
            yield pd.Series(list(embedder(t.tolist()) @ known.T))

    lexical = F.transform("hits", lambda h: h["technique"])
    scores = F.zip_with("_near", F.array(*map(F.lit, names)), lambda s, t: F.struct(s.alias("s"), t.alias("technique")))
    rows = matched(spark, sf_dir).withColumn("_near", similar("content"))
    return rows.select("link", F.array_join(R.shortlist(lexical, scores, 5), ",").alias("shortlist"))


def sentence_clamp(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(R.sentence_clamp(F.coalesce("text", F.lit("")), 300), 256).alias("clamped"))


def atom_feed(spark, sf_dir):
    rows = scored(spark, sf_dir).where("alignment = 'insider'").orderBy(F.desc_nulls_last("published"), "row_ord").limit(50)
    return R.atom_entries(rows)


def boot_snapshot(spark, sf_dir):
    """The newest rows over the floor, cut down to what a first page shows."""
    rows = scored(spark, sf_dir).where("relevance_score >= 0.3").orderBy(F.desc_nulls_last("published"), "row_ord").limit(75)
    return rows.select("link", F.substring("title", 1, 60).alias("title"), "relevance_score", F.array_join(F.transform("hits", lambda h: h["technique"]), ",").alias("techniques"), F.array_join("use_cases", ",").alias("use_cases"))


def board_report(spark, sf_dir):
    """The twelve techniques of most cases, each with up to eight of its actions, proven ones first."""
    uses = C._uses(spark, sf_dir)
    top = uses.groupBy("technique").agg(F.count(F.lit(1)).alias("cases")).orderBy(F.desc("cases"), "technique").limit(12)
    return L.behaviours(C._strong(spark, sf_dir), X.methods(spark, sf_dir), 8).join(F.broadcast(top), "technique").select("technique", "cases", "rank", "action")


def _counts(spark, sf_dir):
    return C._uses(spark, sf_dir).groupBy("technique").agg(F.count(F.lit(1)).alias("cases"))


def hunt_worklist(spark, sf_dir):
    signature = F.substring(F.sha2(F.concat_ws("|", "technique", F.col("cases").cast("string")), 256), 1, 16)
    cache = _counts(spark, sf_dir).where("technique like '%2'").select("technique", signature.alias("signature"))
    return R.hunt_worklist(_counts(spark, sf_dir), cache)


def recovery_merge(spark, sf_dir):
    h = _history(spark, sf_dir).withColumn("rich", richness())
    return R.keep_richer(h.where("gen = 1"), h.where("gen = 2"))


def stale_enrichments(spark, sf_dir):
    """Newest generations of an older schema or low confidence, lowest first."""
    h = _history(spark, sf_dir)
    last = h.groupBy("link").agg(F.max_by(F.struct("gen", "schema", "confidence"), "gen").alias("g")).select("link", "g.*")
    return last.where("schema < 3 or confidence < 0.2").orderBy("schema", "confidence", "link").limit(200)


def docket_summary(spark, sf_dir):
    supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    named = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    parties = F.array_sort(F.collect_list("s_name"))
    by = named.groupBy("n_name").agg(F.min("s_suppkey").cast("string").alias("docket"), parties.alias("parties"))
    return by.select("n_name", R.docket_summary(F.col("n_name"), F.col("docket"), F.lit(""), F.col("parties")).alias("summary"))


def docket_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumns({"text": F.coalesce("text", F.lit("")), "role": F.coalesce("role", F.lit(""))})
    return R.docket_text(rows, "conv_id", "turn", "role", "text", 500).select("conv_id", F.length("body").alias("n"), F.sha2("body", 256).alias("sha"))


def history_windows(spark, sf_dir):
    span = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("last"))
    w = span.select(F.explode(R.history_windows(F.col("first"), F.col("last"))).alias("w"))
    return w.select("w.nth", F.date_format("w.from", "yyyy-MM-dd").alias("first_day"), F.date_format("w.to", "yyyy-MM-dd").alias("last_day"))


def proof_labels(spark, sf_dir):
    """A case's best label: confirmed, alleged or reported."""
    label = F.when(F.col("claimed").isin("adjudicated", "admitted"), "confirmed").when(F.col("claimed") == "alleged", "alleged").otherwise("reported")
    return C._strong(spark, sf_dir).groupBy(label.alias("label"), "posture").agg(F.count(F.lit(1)).alias("cases"))


def technique_tools(spark, sf_dir):
    """Tool categories of each technique by shared controls, the most detections first."""
    tools = spark.createDataFrame([(t, c) for t, cs in C.TOOLS for c in cs], "tool string, control string")
    kind = lambda k: F.count_distinct(F.when(F.col("kind") == k, F.col("control")))
    both = tools.join(C._controls(spark), "control").join(_counts(spark, sf_dir), "technique")
    return both.groupBy("technique", "tool").agg(kind("detection").alias("detections"), kind("prevention").alias("preventions"))


def observables_by_artifact(spark, sf_dir):
    """Record families and channels seen together, with the share of mechanical traces."""
    m = X.methods(spark, sf_dir).groupBy("family", "channel")
    share = F.bround(F.avg((F.col("basis") == "mechanically_implied").cast("double")), 4)
    return m.agg(F.count(F.lit(1)).alias("observables"), share.alias("mechanical_share"))


def channel_chips(spark, sf_dir):
    return X.articles(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("articles")).orderBy(F.desc("articles"), "channel")


QUERIES = {
    f.__name__: f
    for f in (
        novel_candidates, candidate_counts, llm_ref_merge, technique_shortlist, sentence_clamp, atom_feed, boot_snapshot, board_report,
        hunt_worklist, recovery_merge, stale_enrichments, docket_summary, docket_text, history_windows, proof_labels, technique_tools,
        observables_by_artifact, channel_chips,
    )
}

_CAND = """rec AS (SELECT label * 40 + vec_id % 40 AS cluster, vec_id AS id, vec_id % 7 AS story, vec_id % 3 AS domain,
  CASE WHEN label = 4 THEN 0 ELSE vec_id % 3 END AS r, embedding::DOUBLE[] AS v, vec_id % 365 AS seen FROM embeddings WHERE vec_id > 2),
g AS (SELECT cluster, count(DISTINCT story) AS stories, count(DISTINCT domain) AS domains, ['weak', 'moderate', 'strong'][max(r) + 1] AS strength, arg_min(v, id) AS rep, min(seen) AS first_seen, max(seen) AS last_seen FROM rec GROUP BY cluster),
s AS (SELECT cluster, 'T' || vec_id AS t, round_even(list_dot_product(rep, embedding::DOUBLE[]) / (sqrt(list_dot_product(rep, rep)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS s FROM g, embeddings WHERE vec_id <= 2),
b AS (SELECT cluster, max(s) AS s, arg_max(t, (s, t)) AS t FROM s GROUP BY cluster),
cand AS (SELECT cluster, stories, domains, strength, first_seen, last_seen, round_even(s, 4) AS similarity, t AS nearest,
  CASE WHEN strength = 'weak' THEN 'seed' WHEN stories >= 2 AND s < 0.3 THEN 'eligible' WHEN stories >= 2 THEN 'corroborated' ELSE 'seed' END AS status FROM g JOIN b USING (cluster))"""
_esc = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_IDS = [t[0] for t in X.TAXONOMY]
_end = lambda sep: f"CASE WHEN strpos(reverse(cut), '{sep[::-1]}') > 0 THEN length(cut) - strpos(reverse(cut), '{sep[::-1]}') - 1 ELSE -1 END"
_SIG = "substr(sha256(technique || '|' || cases), 1, 16)"
ORACLE_SQL = {
    "novel_candidates": f"WITH {_CAND} SELECT * FROM cand",
    "candidate_counts": f"WITH {_CAND} SELECT status, count(*) AS candidates FROM cand GROUP BY status",
    "llm_ref_merge": f"""WITH {HITS}, r AS (SELECT row_ord, link, i, {[*_IDS, "ZZ999"]}[(row_ord * 3 + i * 5) % 11 + 1] AS id, (row_ord * 7 + i * 13) % 100 / 100.0::DOUBLE AS c FROM article, range(8) t(i)),
        k AS (SELECT row_ord, id, min(i) AS i FROM r WHERE c >= 0.6 AND id <> 'ZZ999' AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.row_ord = r.row_ord AND technique = id) GROUP BY row_ord, id QUALIFY row_number() OVER (PARTITION BY row_ord ORDER BY min(i)) <= 5)
        SELECT link, coalesce(string_agg(id, ',' ORDER BY i), '') AS added FROM article LEFT JOIN k USING (row_ord) GROUP BY link""",
    "sentence_clamp": f"""WITH w AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS whole FROM documents), c AS (SELECT *, substr(whole, 1, 300) AS cut FROM w),
        e AS (SELECT *, {_end(". ")} AS a, {_end("! ")} AS b, {_end("? ")} AS q FROM c)
        SELECT doc_id, sha256(CASE WHEN length(whole) <= 300 THEN whole WHEN a >= 150 THEN substr(cut, 1, a + 1) WHEN b >= 150 THEN substr(cut, 1, b + 1) WHEN q >= 150 THEN substr(cut, 1, q + 1)
               ELSE rtrim(substr(cut, 1, greatest(length(cut) - strpos(reverse(cut), ' '), 0))) || '…' END) AS clamped FROM e""",
    "atom_feed": f"""WITH {SCORED}, r AS (SELECT * FROM scored WHERE alignment = 'insider' ORDER BY published DESC NULLS LAST, row_ord LIMIT 50)
        SELECT link, '<entry><title>' || {_esc("CASE WHEN title <> '' THEN title ELSE link END")} || '</title><link href="' || {_esc("link")} || '"/><id>' || {_esc("link")} || '</id><updated>'
          || strftime(coalesce(published, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') || '</updated><source><title>' || {_esc("source_name")} || '</title></source>'
          || array_to_string(list_transform(list_append(use_cases, channel), lambda t: '<category term="' || {_esc("t")} || '"/>'), '') || '<summary type="text">' || {_esc("summary")} || '</summary></entry>' AS entry FROM r""",
    "boot_snapshot": f"""WITH {SCORED}, r AS (SELECT * FROM scored WHERE relevance_score >= 0.3 ORDER BY published DESC NULLS LAST, row_ord LIMIT 75)
        SELECT link, substr(title, 1, 60) AS title, relevance_score, coalesce((SELECT string_agg(technique, ',' ORDER BY theme, technique) FROM hits h WHERE h.row_ord = r.row_ord), '') AS techniques, array_to_string(use_cases, ',') AS use_cases FROM r""",
    "board_report": f"""{C.STRONG}, top AS (SELECT technique, count(*) AS cases FROM uses GROUP BY technique ORDER BY cases DESC, technique LIMIT 12), m AS (SELECT methods.* FROM methods JOIN strong USING (row_ord)),
        d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY technique, lower(trim(action)) ORDER BY row_ord, m_pos) = 1), c AS (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY row_ord, m_pos) AS nth FROM d QUALIFY nth <= 8)
        SELECT technique, cases, CAST(row_number() OVER (PARTITION BY technique ORDER BY claim_status = 'adjudicated' DESC, nth) AS INTEGER) AS rank, action FROM c JOIN top USING (technique)""",
    "hunt_worklist": f"""{C.STRONG}, n AS (SELECT technique, count(*) AS cases FROM uses GROUP BY technique) SELECT technique, cases, {_SIG} AS signature FROM n WHERE cases >= 2 AND technique NOT LIKE '%2' ORDER BY cases DESC, technique LIMIT 10""",
    "recovery_merge": f"""WITH {HISTORY} SELECT c.link, CASE WHEN c.n_methods = 0 AND coalesce(d.rich, -1) > c.rich THEN d.gen ELSE c.gen END AS gen, CASE WHEN c.n_methods = 0 AND coalesce(d.rich, -1) > c.rich THEN 'donor' ELSE 'current' END AS source
        FROM rich c LEFT JOIN rich d ON d.link = c.link AND d.gen = 2 WHERE c.gen = 1""",
    "stale_enrichments": f"""WITH {HISTORY}, l AS (SELECT link, gen, schema, confidence FROM history QUALIFY row_number() OVER (PARTITION BY link ORDER BY gen DESC) = 1)
        SELECT * FROM l WHERE schema < 3 OR confidence < 0.2 ORDER BY schema, confidence, link LIMIT 200""",
    "docket_summary": """WITH s AS (SELECT n_name, min(s_suppkey) AS docket, list_sort(list(s_name))[1:8] AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
        SELECT n_name, 'Court: ' || n_name || chr(10) || 'Docket: ' || docket || chr(10) || 'Parties: ' || array_to_string(p, '; ') AS summary FROM s""",
    "docket_text": """WITH c AS (SELECT conv_id, turn, '--- Document ' || turn || CASE WHEN coalesce(role, '') <> '' THEN ': ' || role ELSE '' END || ' ---' || chr(10) || trim(text) AS body FROM conversations WHERE trim(coalesce(text, '')) <> ''),
        b AS (SELECT *, coalesce(sum(length(body) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
        j AS (SELECT conv_id, string_agg(substr(body, 1, CAST(500 - before AS INTEGER)), chr(10) || chr(10) ORDER BY turn) AS body FROM b WHERE before < 500 GROUP BY conv_id) SELECT conv_id, CAST(length(body) AS INTEGER) AS n, sha256(body) AS sha FROM j""",
    "history_windows": """WITH s AS (SELECT min(o_orderdate)::DATE AS f, max(o_orderdate)::DATE AS l FROM orders)
        SELECT CAST(i AS INTEGER) AS nth, strftime(l - CAST((i + 1) * 90 - 1 AS INTEGER), '%Y-%m-%d') AS first_day, strftime(l - CAST(i * 90 AS INTEGER), '%Y-%m-%d') AS last_day FROM s, range(10000) t(i) WHERE i <= (l - f) // 90""",
    "proof_labels": f"{C.STRONG} SELECT CASE WHEN w >= 3 THEN 'confirmed' WHEN w = 2 THEN 'alleged' ELSE 'reported' END AS label, posture, count(*) AS cases FROM strong GROUP BY ALL",
    "technique_tools": f"""{C._COVER} SELECT technique, tool, count(DISTINCT control) FILTER (kind = 'detection') AS detections, count(DISTINCT control) FILTER (kind = 'prevention') AS preventions
        FROM tools JOIN controls USING (control) JOIN counts USING (technique) GROUP BY technique, tool""",
    "observables_by_artifact": f"WITH {X.METHODS_SQL} SELECT family, channel, count(*) AS observables, round_even(avg(CASE WHEN basis = 'mechanically_implied' THEN 1.0::DOUBLE ELSE 0 END), 4) AS mechanical_share FROM methods GROUP BY family, channel",
    "channel_chips": f"WITH {A} SELECT channel, count(*) AS articles FROM article GROUP BY channel",
}

"""Queries of the evidence ledger and of tools, over cases made from orders and lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselode.operators import ledger as L
from caselode.operators import vendors as V
from caselode.operators.reports import method_strength
from caselode.sources import fixtures as X

ROLE_RULES = [("engineer", "engineering"), ("developer", "engineering"), ("sales", "commercial"), ("contractor", "external")]
CONTROLS = [(f"DT{i:02d}", "detection", f"{t}{n:03d}") for i in range(6) for t, n in ((X.THEMES[i % 5], i % 5 + 1), (X.THEMES[(i + 2) % 5], 1))]
CONTROLS += [(f"PV{i:02d}", "prevention", f"{t}{n:03d}") for i in range(4) for t, n in ((X.THEMES[i], 2), (X.THEMES[(i + 3) % 5], i + 1))]
TOOLS = [("siem", ["DT00", "DT01"]), ("dlp", ["DT02", "PV00"]), ("edr", ["DT03", "PV01"]), ("iam", ["PV02", "PV03"]), ("uba", ["DT04"]), ("casb", ["DT05", "PV03"])]
CROSSWALK = [("economy records", "DT00"), ("standard records", "DT01"), ("standard records", "DT02"), ("promotional records", "DT03"), ("small records", "DT04")]
_B = f"WITH {X.CASES_SQL}, {X.METHODS_SQL}"
_w = lambda table, col: "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"
STRONG = f"""{_B}, best AS (SELECT row_ord, max({_w(L.STRENGTH, "claim_status")}) AS w FROM methods GROUP BY row_ord),
weighed AS (SELECT c.*, coalesce(w, 1) AS w, {_w(L.POSTURE_WEIGHT, "posture")} AS p FROM cases c LEFT JOIN best USING (row_ord) WHERE verdict IS TRUE),
strong AS (SELECT *, ['reported', 'alleged', 'admitted', 'adjudicated'][CASE WHEN p < 4 THEN least(w, 2) ELSE w END] AS strength, p < 4 AND w > 2 AS capped FROM weighed),
uses AS (SELECT row_ord, m_pos, technique, family, title, year, strength FROM methods JOIN strong USING (row_ord))"""
_CTRL = X.values_sql("controls", "control, kind, technique", CONTROLS)
_TOOLS = X.values_sql("tools", "tool, control", [(t, c) for t, cs in TOOLS for c in cs])
_COVER = f"""{STRONG}, {_CTRL}, {_TOOLS}, counts AS (SELECT technique, count(*) AS cases FROM uses GROUP BY technique),
cover AS (SELECT tool, technique, any_value(cases) AS cases, CASE WHEN bool_or(kind = 'detection') AND bool_or(kind = 'prevention') THEN 'both' WHEN bool_or(kind = 'detection') THEN 'detect' ELSE 'prevent' END AS how
          FROM tools JOIN controls USING (control) JOIN counts USING (technique) GROUP BY tool, technique)"""
_first = lambda word, name: f"WHEN contains(lower(role), '{word}') THEN '{name}'"
_FN = "CASE " + " ".join(_first(*r) for r in ROLE_RULES) + " ELSE 'unknown' END"


def _views(spark, sf_dir):
    return X.cases(spark, sf_dir), X.methods(spark, sf_dir)


def _strong(spark, sf_dir):
    return L.case_strength(*_views(spark, sf_dir))


def _uses(spark, sf_dir):
    return L.case_techniques(_strong(spark, sf_dir), X.methods(spark, sf_dir))


def _controls(spark):
    return spark.createDataFrame(CONTROLS, "control string, kind string, technique string")


def ledger_basis(spark, sf_dir):
    return L.basis(*_views(spark, sf_dir))


def ledger_strength(spark, sf_dir):
    return L.strength_totals(_strong(spark, sf_dir))


def posture_mix(spark, sf_dir):
    return L.posture_mix(_strong(spark, sf_dir))


def quote_grounding(spark, sf_dir):
    return L.quote_grounding(*_views(spark, sf_dir))


def role_axes(spark, sf_dir):
    return L.role_axes(_strong(spark, sf_dir), ROLE_RULES)


def technique_strength(spark, sf_dir):
    return L.technique_strength(_uses(spark, sf_dir))


def technique_exemplars(spark, sf_dir):
    return L.technique_exemplars(_uses(spark, sf_dir))


def technique_families(spark, sf_dir):
    return L.technique_families(_uses(spark, sf_dir), X.methods(spark, sf_dir))


def theme_rollup(spark, sf_dir):
    return L.theme_rollup(_uses(spark, sf_dir))


def year_technique_top5(spark, sf_dir):
    return L.year_top(_uses(spark, sf_dir))


def channel_coverage(spark, sf_dir):
    return L.channel_coverage(_strong(spark, sf_dir), X.methods(spark, sf_dir), X.OBSERVED_CHANNELS)


def evidence_families(spark, sf_dir):
    return L.evidence_families(_strong(spark, sf_dir), X.methods(spark, sf_dir))


def behaviors_capped(spark, sf_dir):
    return L.behaviours(_strong(spark, sf_dir), X.methods(spark, sf_dir), cap=6)


def detection_corroboration(spark, sf_dir):
    crosswalk = spark.createDataFrame(CROSSWALK, "family string, control string")
    return L.corroboration(_uses(spark, sf_dir), X.methods(spark, sf_dir), _controls(spark), crosswalk)


def _cover(spark, sf_dir):
    counts = _uses(spark, sf_dir).groupBy("technique").agg(F.count(F.lit(1)).alias("cases"))
    tools = spark.createDataFrame([(t, c) for t, cs in TOOLS for c in cs], "tool string, control string")
    return L.tool_cover(counts, _controls(spark), tools), counts


def tool_covered_techniques(spark, sf_dir):
    return _cover(spark, sf_dir)[0]


def tool_ranking(spark, sf_dir):
    return L.tool_ranking(*_cover(spark, sf_dir))


def evidence_strength(spark, sf_dir):
    mechanical = F.col("basis") == "mechanically_implied"
    label = method_strength(F.col("claim_status"), mechanical, ~mechanical)
    return X.methods(spark, sf_dir).groupBy("technique", label.alias("label")).agg(F.count(F.lit(1)).alias("methods"))


#: (category, vendor, aliases); "bolt" has two homes, and "blue bolt" hides the "blue" in it.
VENDORS = [("fasteners", "Bolt & Co", ["bolt"]), ("machines", "Bolt & Co", ["bolt"]), ("machines", "Blue Bolt", ["blue bolt"]), ("colours", "Blue", ["blue"]), ("colours", "Red", ["red"]), ("machines", "Gear", ["gear"])]
_PARTS = "parts AS (SELECT p_partkey, 'part:' || p_partkey AS link, p_name AS text, p_size % 2 = 0 AS verdict FROM part)"
# token-based: a name is two words; the longer alias is taken first, and what it covers is used up
_ALIAS = "CASE WHEN text = 'blue bolt' THEN ['blue bolt'] ELSE list_intersect(string_split(text, ' '), ['bolt', 'blue', 'red', 'gear']) END"
_MENTIONS = f"""{_PARTS}, {X.values_sql("homes", "category, vendor, alias", [(c, v, a) for c, v, al in VENDORS for a in al])},
found AS (SELECT p_partkey, link, verdict, unnest({_ALIAS}) AS alias FROM parts), mentions AS (SELECT DISTINCT category, vendor, p_partkey, link, verdict FROM found JOIN homes USING (alias))"""


def _parts(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.concat(F.lit("part:"), "p_partkey").alias("link"), F.col("p_name").alias("text"), (F.col("p_size") % 2 == 0).alias("verdict"))


def vendor_mentions(spark, sf_dir):
    return V.mention_counts(V.mentions(_parts(spark, sf_dir), VENDORS))


def vendor_receipts(spark, sf_dir):
    return V.receipts(V.mentions(_parts(spark, sf_dir), VENDORS), order=[F.desc("p_partkey")], n=25).select("category", "vendor", "nth", "link", "more_cases")


def vendor_directory(spark, sf_dir):
    return V.directory(V.mention_counts(V.mentions(_parts(spark, sf_dir), VENDORS)))


QUERIES = {
    f.__name__: f
    for f in (
        ledger_basis, ledger_strength, posture_mix, quote_grounding, role_axes, technique_strength, technique_exemplars, technique_families,
        theme_rollup, year_technique_top5, channel_coverage, evidence_families, behaviors_capped, detection_corroboration,
        tool_covered_techniques, tool_ranking, evidence_strength, vendor_mentions, vendor_receipts, vendor_directory,
    )
}

_round = lambda a, b: f"CAST(round_even(100.0::DOUBLE * {a} / {b}, 0) AS INTEGER)"
ORACLE_SQL = {
    "ledger_basis": f"""{_B} SELECT count(*) AS total, count(verdict) AS with_verdict, count(*) FILTER (verdict) AS verdict_true, count(*) FILTER (verdict AND row_ord IN (SELECT row_ord FROM methods)) AS contributing,
        count(*) FILTER (NOT verdict) AS excluded_non_insider, count(*) FILTER (verdict IS NULL) AS excluded_no_verdict FROM cases""",
    "ledger_strength": f"{STRONG} SELECT strength, count(*) AS cases, count(*) FILTER (capped) AS capped FROM strong GROUP BY strength",
    "posture_mix": f"{STRONG} SELECT posture, NULL AS model, count(*) AS cases FROM strong GROUP BY posture UNION ALL SELECT NULL, model, count(*) FROM strong GROUP BY model",
    "quote_grounding": f"""{_B}, q AS (SELECT m.* FROM methods m JOIN cases USING (row_ord) WHERE cases.verdict IS TRUE AND has_quote), n AS (
        SELECT count(*) FILTER (verbatim) AS verbatim, count(*) FILTER (NOT verbatim) AS not_verbatim, count(*) FILTER (verbatim IS NULL) AS unstamped FROM q)
        SELECT *, {_round("verbatim", "(verbatim + not_verbatim)")} AS share FROM n""",
    "role_axes": f"""{STRONG}, f AS (SELECT strength, lower(role) AS role, {_FN} AS fn FROM strong), a AS (
        SELECT 'function' AS axis, fn AS value, strength FROM f UNION ALL
        SELECT 'state', CASE WHEN contains(role, 'former') OR contains(role, 'left') THEN 'former' WHEN contains(role, 'current') OR fn <> 'unknown' THEN 'current' ELSE 'unknown' END, strength FROM f)
        SELECT axis, value, count(*) AS cases, count(*) FILTER (strength = 'adjudicated') AS adjudicated,
               CASE WHEN count(*) >= 10 THEN {_round("count(*) FILTER (strength = 'adjudicated')", "count(*)")} END AS share FROM a GROUP BY axis, value""",
    "technique_strength": f"{STRONG} SELECT technique, count(*) AS cases, " + ", ".join(f"count(*) FILTER (strength = '{s}') AS {s}" for s in L.STRENGTH) + " FROM uses GROUP BY technique",
    "technique_exemplars": f"{STRONG} SELECT technique, row_number() OVER w AS nth, substr(title, 1, 90) AS title FROM uses WINDOW w AS (PARTITION BY technique ORDER BY row_ord, m_pos) QUALIFY nth <= 3",
    "technique_families": f"""{STRONG}, fam AS (SELECT DISTINCT row_ord, family AS record FROM methods), n AS (SELECT technique, record, count(*) AS cases FROM uses JOIN fam USING (row_ord) GROUP BY ALL)
        SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY technique ORDER BY cases DESC, record) <= 5""",
    "theme_rollup": f"{STRONG} SELECT substr(technique, 1, 2) AS theme, count(*) AS observations, count(DISTINCT technique) AS techniques FROM uses GROUP BY 1",
    "year_technique_top5": f"""{STRONG}, n AS (SELECT coalesce(year, '????') AS year, technique, count(*) AS cases, min((row_ord, m_pos)) AS first FROM uses GROUP BY 1, 2)
        SELECT year, technique, cases FROM n QUALIFY row_number() OVER (PARTITION BY year ORDER BY cases DESC, first) <= 5""",
    "channel_coverage": f"""{STRONG}, {X.values_sql("listed", "channel", [(c,) for c in X.OBSERVED_CHANNELS])}, s AS (SELECT channel, row_ord FROM methods JOIN strong USING (row_ord))
        SELECT channel, count(DISTINCT row_ord) AS cases FROM listed LEFT JOIN s USING (channel) GROUP BY channel""",
    "evidence_families": f"""{STRONG}, t AS (SELECT count(*) FILTER (strength = 'adjudicated') AS n FROM strong), f AS (
        SELECT family, count(DISTINCT row_ord) AS cases, count(DISTINCT row_ord) FILTER (claim_status IN ('adjudicated', 'admitted')) AS strong_cases,
               count(*) FILTER (basis = 'mechanically_implied') AS mechanical, count(*) FILTER (basis <> 'mechanically_implied') AS inferred FROM methods JOIN strong USING (row_ord) GROUP BY family)
        SELECT f.*, CASE WHEN n > 0 THEN {_round("strong_cases", "n")} END AS adjudicated_share FROM f, t""",
    "behaviors_capped": f"""{STRONG}, m AS (SELECT methods.* FROM methods JOIN strong USING (row_ord)), d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY technique, lower(trim(action)) ORDER BY row_ord, m_pos) = 1),
        c AS (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY row_ord, m_pos) AS nth FROM d QUALIFY nth <= 6)
        SELECT technique, CAST(row_number() OVER (PARTITION BY technique ORDER BY claim_status = 'adjudicated' DESC, nth) AS INTEGER) AS rank, action, claim_status FROM c""",
    "detection_corroboration": f"""{STRONG}, {_CTRL}, {X.values_sql("cross_walk", "family, control", CROSSWALK)}, fam AS (SELECT DISTINCT row_ord, family FROM methods),
        n AS (SELECT technique, fam.family, count(*) AS cases FROM uses JOIN fam USING (row_ord) GROUP BY technique, fam.family),
        b AS (SELECT technique, control, sum(cases) AS cases, string_agg(family, ',' ORDER BY family) AS families FROM n JOIN cross_walk USING (family) GROUP BY technique, control)
        SELECT technique, control, CAST(coalesce(cases, 0) AS BIGINT) AS cases, coalesce(families, '') AS families, cases IS NOT NULL AS corroborated FROM controls LEFT JOIN b USING (technique, control) WHERE kind = 'detection'""",
    "tool_covered_techniques": f"{_COVER} SELECT tool, technique, cases, how FROM cover",
    "tool_ranking": f"""{_COVER} SELECT tool, CAST(sum(CASE WHEN how <> 'prevent' THEN cases ELSE 0 END) AS BIGINT) AS detects, CAST(sum(CASE WHEN how <> 'detect' THEN cases ELSE 0 END) AS BIGINT) AS prevents,
        CAST(sum(cases) AS BIGINT) AS covers, count(*) AS techniques, round_even(100.0::DOUBLE * sum(cases) / (SELECT sum(cases) FROM counts), 1) AS share FROM cover GROUP BY tool""",
    "evidence_strength": f"""{_B} SELECT technique, CASE WHEN claim_status IN ('adjudicated', 'admitted') AND basis = 'mechanically_implied' THEN 'strong' WHEN claim_status IN ('alleged', 'unclear') AND basis <> 'mechanically_implied' THEN 'weak' ELSE 'moderate' END AS label,
        count(*) AS methods FROM methods GROUP BY ALL""",
    "vendor_mentions": f"WITH {_MENTIONS} SELECT category, vendor, count(DISTINCT link) AS total, count(DISTINCT link) FILTER (verdict) AS verdict_true FROM mentions GROUP BY category, vendor",
    "vendor_receipts": f"""WITH {_MENTIONS} SELECT category, vendor, CAST(row_number() OVER w AS INTEGER) AS nth, link, greatest(count(*) OVER (PARTITION BY category, vendor) - 25, 0) AS more_cases FROM mentions
        WINDOW w AS (PARTITION BY category, vendor ORDER BY p_partkey DESC, link) QUALIFY nth <= 25""",
    "vendor_directory": f"""WITH {_MENTIONS}, n AS (SELECT category, vendor, count(DISTINCT link) AS total, count(DISTINCT link) FILTER (verdict) AS verdict_true FROM mentions GROUP BY category, vendor)
        SELECT vendor, max(total) AS total, max(verdict_true) AS verdict_true, string_agg(category, ',' ORDER BY category) AS categories FROM n GROUP BY vendor""",
}

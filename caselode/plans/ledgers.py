"""The ledger's composite queries: every section from one scan of cases and one of methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselode.operators import ledger_facts as LF
from caselode.plans import casework as C
from caselode.sources import fixtures as X

TITLES = [(f"DT{i:02d}", f"Detection {'ABCDEF'[i]}") for i in range(5)]


def cut(spark, sf_dir):
    # methods count where the verdict is true only; the keys of those cases are one more narrow scan, less than what they save
    whole = LF.whole_cases(X.cases(spark, sf_dir), X.methods(spark, sf_dir, true_only=True))
    return LF.sections(LF.staged(LF.facts(whole, C.ROLE_RULES, X.OBSERVED_CHANNELS)), X.OBSERVED_CHANNELS)


def ledger_sections(spark, sf_dir):
    return cut(spark, sf_dir).drop("text")


def ledger_payload(spark, sf_dir):
    """The ledger as one JSON row; its digest, as engines write JSON differently."""
    return LF.payload(cut(spark, sf_dir)).select(F.json_array_length(F.get_json_object("ledger", "$.technique")).alias("techniques"), F.json_array_length(F.get_json_object("ledger", "$.basis")).alias("basis"), F.get_json_object("ledger", "$.basis[0].n").cast("long").alias("contributing"))


def evidence_records(spark, sf_dir):
    return LF.evidence_records(cut(spark, sf_dir))


def tool_dossiers(spark, sf_dir):
    tools = spark.createDataFrame([(t, c) for t, cs in C.TOOLS for c in cs], "tool string, control string")
    crosswalk = spark.createDataFrame(C.CROSSWALK, "family string, control string")
    return LF.tool_dossiers(cut(spark, sf_dir), C._controls(spark), tools, crosswalk)


def detection_totals(spark, sf_dir):
    return LF.detection_totals(C.detection_corroboration(spark, sf_dir), spark.createDataFrame(TITLES, "control string, title string"))


QUERIES = {f.__name__: f for f in (ledger_sections, ledger_payload, evidence_records, tool_dossiers, detection_totals)}

_CASES = "SELECT 'basis' AS section, '{0}' AS a, '' AS b, count(*) FILTER ({1}) AS n, 0 AS strong, 0 AS rank FROM cases"
_FULL = f"""{C.STRONG}, {X.values_sql("listed", "channel", [(c,) for c in X.OBSERVED_CHANNELS])},
m AS (SELECT methods.*, s.strength, s.year FROM methods JOIN strong s USING (row_ord)),
fam AS (SELECT DISTINCT row_ord, family FROM m),
roles AS (SELECT *, {C._FN} AS fn FROM strong),
seen AS (SELECT family, channel, count(*) AS n, min((row_ord, m_pos)) AS first FROM m WHERE channel IS NOT NULL GROUP BY ALL),
shown AS (SELECT family, lower(trim(artifact)) AS artifact, count(*) AS n, min((row_ord, m_pos, substr(trim(artifact), 1, 70))) AS first FROM m WHERE trim(artifact) <> '' GROUP BY ALL),
yt AS (SELECT coalesce(year, '????') AS y, technique, count(*) AS n, min((row_ord, m_pos)) AS first FROM m GROUP BY 1, 2),
tf AS (SELECT technique, fam.family, count(*) AS n FROM m JOIN fam USING (row_ord) GROUP BY technique, fam.family),
one_family AS (SELECT family, count(DISTINCT row_ord) AS n, count(DISTINCT row_ord) FILTER (claim_status IN ('adjudicated', 'admitted')) AS strong FROM m GROUP BY family),
examples AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY first) AS rank FROM shown QUALIFY rank <= 3),
channels AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, first) AS rank FROM seen QUALIFY rank <= 3)"""
_BASIS = {"total": "true", "with_verdict": "verdict IS NOT NULL", "verdict_true": "verdict", "contributing": "verdict AND row_ord IN (SELECT row_ord FROM methods)", "excluded_non_insider": "NOT verdict", "excluded_no_verdict": "verdict IS NULL"}
_STATE = "CASE WHEN contains(lower(role), 'former') OR contains(lower(role), 'left') THEN 'former' WHEN contains(lower(role), 'current') OR fn <> 'unknown' THEN 'current' ELSE 'unknown' END"
_SECTIONS = " UNION ALL ".join(
    [_CASES.format(k, v) for k, v in _BASIS.items()]
    + [
        "SELECT 'strength', strength, '', count(*), count(*) FILTER (capped), 0 FROM strong GROUP BY strength",
        "SELECT 'posture', posture, '', count(*), 0, 0 FROM strong GROUP BY posture",
        "SELECT 'model', model, '', count(*), 0, 0 FROM strong GROUP BY model",
        "SELECT 'role_function', fn, '', count(*), count(*) FILTER (strength = 'adjudicated'), 0 FROM roles GROUP BY fn",
        f"SELECT 'role_state', {_STATE} AS st, '', count(*), count(*) FILTER (strength = 'adjudicated'), 0 FROM roles GROUP BY st",
        "SELECT 'technique', technique, strength, count(*), 0, 0 FROM m GROUP BY technique, strength",
        "SELECT 'quotes', CASE WHEN verbatim THEN 'verbatim' WHEN NOT verbatim THEN 'not_verbatim' ELSE 'unstamped' END AS q, '', count(*), 0, 0 FROM m WHERE has_quote GROUP BY q",
        "SELECT 'family', family, '', n, strong, 0 FROM one_family",
        "SELECT 'family_basis', family, CASE WHEN basis = 'mechanically_implied' THEN 'mechanical' ELSE 'inferred' END AS k, count(*), 0, 0 FROM m GROUP BY family, k",
        "SELECT 'family_channel', family, channel, n, 0, rank FROM channels",
        "SELECT 'family_example', family, artifact, n, 0, rank FROM examples",
        "SELECT 'channel', l.channel, '', count(DISTINCT row_ord), 0, 0 FROM listed l LEFT JOIN m ON m.channel = l.channel GROUP BY l.channel",
        "SELECT * FROM (SELECT 'year_technique', y, technique, n, 0, row_number() OVER (PARTITION BY y ORDER BY n DESC, first) AS r FROM yt) WHERE r <= 5",
        "SELECT * FROM (SELECT 'technique_family', technique, family, n, 0, row_number() OVER (PARTITION BY technique ORDER BY n DESC, family) AS r FROM tf) WHERE r <= 5",
    ]
)
ORACLE_SQL = {
    "ledger_sections": f"{_FULL} SELECT section, a, b, CAST(n AS BIGINT) AS n, CAST(strong AS BIGINT) AS strong, CAST(rank AS INTEGER) AS rank FROM ({_SECTIONS})",
    "ledger_payload": f"{_FULL} SELECT CAST(count(*) FILTER (section = 'technique') AS INTEGER) AS techniques, CAST(count(*) FILTER (section = 'basis') AS INTEGER) AS basis, CAST(max(n) FILTER (section = 'basis' AND a = 'contributing') AS BIGINT) AS contributing FROM ({_SECTIONS})",
    "evidence_records": f"""{_FULL}, c AS (SELECT family, string_agg(channel || ':' || n, ', ' ORDER BY rank) AS channels FROM channels GROUP BY family),
        e AS (SELECT family, string_agg(first[3], ', ' ORDER BY rank) AS examples FROM examples GROUP BY family),
        b AS (SELECT family, count(*) FILTER (basis = 'mechanically_implied') AS mechanical, count(*) FILTER (basis <> 'mechanically_implied') AS inferred FROM m GROUP BY family),
        t AS (SELECT count(*) FILTER (strength = 'adjudicated') AS n FROM strong)
        SELECT family, f.n AS cases, f.strong AS strong_cases, mechanical, inferred, coalesce(channels, '') AS channels, coalesce(examples, '') AS examples, CASE WHEN t.n > 0 THEN {C._round("f.strong", "t.n")} END AS adjudicated_share
        FROM one_family f JOIN b USING (family) LEFT JOIN c USING (family) LEFT JOIN e USING (family), t""",
    "tool_dossiers": f"""{_FULL}, {C._CTRL}, {C._TOOLS}, {X.values_sql("cross_walk", "family, control", C.CROSSWALK)},
        o AS (SELECT technique, count(*) AS cases FROM m WHERE technique IN (SELECT technique FROM controls) GROUP BY technique), v AS (SELECT sum(cases) AS v FROM o),
        k AS (SELECT tool, technique, bool_or(kind = 'detection') AS d, bool_or(kind = 'prevention') AS p FROM tools JOIN controls USING (control) GROUP BY ALL),
        cov AS (SELECT tool, technique, cases, d, p, row_number() OVER (PARTITION BY tool ORDER BY cases DESC, technique) AS r FROM k JOIN o USING (technique)),
        s AS (SELECT tool, coalesce(sum(cases) FILTER (d), 0) AS detects, coalesce(sum(cases) FILTER (p), 0) AS prevents,
                string_agg(technique || ':' || CASE WHEN d AND p THEN 'both' WHEN d THEN 'detect' ELSE 'prevent' END || ':' || cases, ', ' ORDER BY r) FILTER (r <= 6) AS techniques FROM cov GROUP BY tool),
        bk AS (SELECT DISTINCT tool, f.family, f.n FROM tools JOIN controls c USING (control) JOIN cross_walk w USING (control) JOIN one_family f ON f.family = w.family WHERE c.kind = 'detection'),
        n AS (SELECT tool, max(n) AS corroborated, string_agg(family, ', ' ORDER BY n DESC, family) AS via FROM bk GROUP BY tool),
        r AS (SELECT t.tool, coalesce(detects, 0) AS detects, coalesce(prevents, 0) AS prevents, coalesce(corroborated, 0) AS corroborated, coalesce(via, '') AS via, coalesce(techniques, '') AS techniques
              FROM (SELECT DISTINCT tool FROM tools) t LEFT JOIN s USING (tool) LEFT JOIN n USING (tool))
        SELECT tool, CAST(detects AS BIGINT) AS detects, CAST(prevents AS BIGINT) AS prevents, {C._round("detects", "v")} AS detect_share, {C._round("prevents", "v")} AS prevent_share, corroborated, via, techniques,
               CAST(row_number() OVER (ORDER BY detects DESC, prevents DESC, corroborated DESC, tool) AS INTEGER) AS place FROM r, v""",
    "detection_totals": f"""WITH c AS ({C.ORACLE_SQL["detection_corroboration"]}), {X.values_sql("titles", "control, title", TITLES)}
        SELECT technique, count(*) AS in_scope, count(*) FILTER (corroborated) AS corroborated, coalesce(string_agg(coalesce(title, c.control), ', ' ORDER BY cases DESC, c.control) FILTER (corroborated), '') AS titles
        FROM c LEFT JOIN titles ON titles.control = c.control GROUP BY technique""",
}

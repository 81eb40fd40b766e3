"""Adapters from the test tables to the engine's schemas, and the small dimension tables.

The lexicons, rules and control sets here are synthetic inputs: operators take
them as parameters. Values that results depend on are stated plainly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (technique, title, theme, aliases); a child's id is its parent's, a point and a number.
TAXONOMY = [
    ("AF001", "Cover tracks", "anti-forensics", ["here"]),
    ("AF002", "Wipe media", "anti-forensics", ["neverpresent"]),
    ("IF001", "Licence abuse", "infringement", ["apache license", "licensed under"]),
    ("IF001.001", "Licence abuse: short form", "infringement", ["mit license"]),
    ("IF002", "Joint use", "infringement", ["und"]),
    ("ME001", "Means", "means", ["thing"]),
    ("MT001", "Grievance", "motive", ["from", "than"]),
    ("MT002", "Articles", "motive", ["les"]),
    ("PR001", "Preparation", "preparation", ["que"]),
    ("PR001.001", "Preparation: plural", "preparation", ["los"]),
]
#: (control, kind, techniques)
CONTROLS = [
    ("DT001", "detection", ["AF001", "IF001", "MT001"]),
    ("DT002", "detection", ["IF001.001", "IF002"]),
    ("DT003", "detection", ["ME001", "MT002"]),
    ("DT004", "detection", ["PR001", "PR001.001"]),
    ("DT005", "detection", ["AF002", "MT001"]),
    ("DT006", "detection", ["ME001", "IF002"]),
    ("PV001", "prevention", ["IF001", "IF001.001"]),
    ("PV002", "prevention", ["MT001", "MT002", "ME001"]),
    ("PV003", "prevention", ["PR001"]),
    ("PV004", "prevention", ["AF001", "AF002"]),
]
#: (use case, techniques, strong phrases, weak phrases), in registry order.
USE_CASES = [
    ("licence-review", ["IF001", "IF001.001"], ["permission is hereby"], ["warranty", "notice"]),
    ("cross-border", ["PR001.001"], ["erst"], ["der die", "keit"]),
    ("staff-conduct", [], ["thre"], ["with", "this"]),
]
#: (type, phrases, techniques), in order of precedence.
INSIDER_TYPES = [("malicious", ["stupid", "loser"], []), ("negligent", ["oned", "with the"], ["MT002"]), ("unintentional", ["that"], ["MT001"])]
FRAMING = ["was", "with", "they", "from the", "about"]
#: (theme, weight of a hit, cap), in the order in which the score is added up. Fixed values.
THEME_WEIGHTS = [
    ("anti-forensics", 0.11, 0.35),
    ("infringement", 0.14, 0.35),
    ("means", 0.08, 0.25),
    ("motive", 0.05, 0.25),
    ("preparation", 0.11, 0.35),
]
#: Top-level names that make a domain, and domains that are passed over.
TOP_LEVEL, SKIPPED = ["com", "org", "net"], ["example.org"]
CHANNELS = ["news", "filings", "tips", "social", "publications"]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as articles; row_ord is the corpus order that ties follow."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    hours = lambda base, unit: F.timestamp_seconds(F.lit(base) + F.col("doc_id") * unit)
    return docs.select(
        F.col("doc_id").alias("row_ord"),
        F.concat(F.lit("doc:"), "doc_id").alias("link"),
        F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, 90).alias("title"),
        F.substring(text, 1, 200).alias("summary"),
        text.alias("content"),
        F.col("source").alias("source_id"),
        F.upper("source").alias("source_name"),
        F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("doc_id") % 5 + 1).cast("int")).alias("channel"),
        F.when(F.col("doc_id") % 17 != 0, hours(1704067200, 3600)).alias("published"),
        hours(1709251200, 60).alias("ingested_at"),
        hours(1709254800, 60).alias("processed_at"),
    )


#: The same adapter for the SQL twins.
ARTICLE_SQL = """article AS (
  SELECT doc_id AS row_ord, 'doc:' || doc_id AS link, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 90) AS title,
         substr(coalesce(text, ''), 1, 200) AS summary, coalesce(text, '') AS content, source AS source_id, upper(source) AS source_name,
         ['news', 'filings', 'tips', 'social', 'publications'][doc_id % 5 + 1] AS channel,
         CASE WHEN doc_id % 17 <> 0 THEN to_timestamp(1704067200 + doc_id * 3600) AT TIME ZONE 'UTC' END AS published,
         to_timestamp(1709251200 + doc_id * 60) AT TIME ZONE 'UTC' AS ingested_at,
         to_timestamp(1709254800 + doc_id * 60) AT TIME ZONE 'UTC' AS processed_at
  FROM documents)"""


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "technique string, title string, theme string, aliases array<string>")


def controls(spark: SparkSession) -> DataFrame:
    """Bridge of (control, kind, technique)."""
    rows = [(c, k, t) for c, k, ts in CONTROLS for t in ts]
    return spark.createDataFrame(rows, "control string, kind string, technique string")


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A WITH element of literal rows, for the SQL twins."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


# ------------------------------------------------------- orders and lineitems as cases

POSTURES = {"1-URGENT": "conviction", "2-HIGH": "plea", "3-MEDIUM": "indictment", "4-NOT SPECIFIED": "complaint", "5-LOW": "unknown"}
ROLES = {
    "AUTOMOBILE": "former systems engineer",
    "BUILDING": "current software developer",
    "FURNITURE": "sales manager who left",
    "HOUSEHOLD": "contractor",
    "MACHINERY": "somebody",
}
OBSERVED_CHANNELS = ["email", "endpoint", "siem", "usb", "print", "cloud", "network", "badge"]
THEMES = ["MT", "ME", "PR", "IF", "AF"]
#: (words that a part's type must hold, artifact family); the first match decides.
FAMILIES = [("ECONOMY", "economy records"), ("STANDARD", "standard records"), ("PROMO", "promotional records"), ("SMALL", "small records")]


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: a case with verdict, posture, model and role."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    pick = lambda table, col: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(col))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.concat(F.lit("order:"), "o_orderkey").alias("link"),
        F.col("o_orderkey").alias("row_ord"),
        F.concat(F.lit("Case "), "o_orderkey", F.lit(" of "), F.col("o_custkey")).alias("title"),
        F.date_format("o_orderdate", "yyyy").alias("year"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("verdict"),
        F.coalesce(pick(POSTURES, "o_orderpriority"), F.lit("unknown")).alias("posture"),
        F.concat(F.lit("model-"), (F.col("o_custkey") % 3).cast("string")).alias("model"),
        F.coalesce(pick(ROLES, "c_mktsegment"), F.lit("")).alias("role"),
    )


def methods(spark: SparkSession, sf_dir: str, true_only: bool = False) -> DataFrame:
    """One row per lineitem: a method with claim status, quote stamp, technique and one observable.

    m_pos orders a case's methods; line numbers repeat, so further columns
    decide. With true_only, methods of the cases whose verdict is true: the
    others are left out before anything else is joined.
    """
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if true_only:
        true = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey")
        item = item.join(true, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    status = (
        F.when(F.col("l_returnflag") == "A", "adjudicated")
        .when(F.col("l_returnflag") == "R", "alleged")
        .when(F.col("l_linestatus") == "F", "admitted")
        .otherwise("reported")
    )
    family = F.lower(F.substring("p_type", 1, 80))
    for word, name in reversed(FAMILIES):
        family = F.when(F.upper("p_type").contains(word), name).otherwise(family)
    theme = F.element_at(F.array(*map(F.lit, THEMES)), (n - 1) % 5 + 1)
    channel = F.when(F.col("p_size") % 9 < 8, F.get(F.array(*map(F.lit, OBSERVED_CHANNELS)), F.col("p_size") % 9))
    return item.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("row_ord"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("m_pos"),
        status.alias("claim_status"),
        (F.col("l_linenumber") % 4 != 0).alias("has_quote"),
        F.when(F.col("l_linenumber") % 4 != 0, F.when(F.col("l_partkey") % 3 == 0, True).when(F.col("l_partkey") % 3 == 1, False)).alias("verbatim"),
        F.concat(theme, F.lpad(F.floor((n - 1) / 5 + 1).cast("string"), 3, "0")).alias("technique"),
        F.col("p_name").alias("action"),
        F.when(F.trim(F.coalesce("p_type", F.lit(""))) == "", "unspecified").otherwise(family).alias("family"),
        channel.alias("channel"),
        F.when(F.col("l_linenumber") % 2 == 1, "mechanically_implied").otherwise("analyst_inference").alias("basis"),
        F.coalesce("p_type", F.lit("")).alias("artifact"),
    )


def _case_sql(table: dict, col: str, default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


CASES_SQL = f"""cases AS (
  SELECT 'order:' || o_orderkey AS link, o_orderkey AS row_ord, 'Case ' || o_orderkey || ' of ' || o_custkey AS title,
         strftime(o_orderdate, '%Y') AS year, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS verdict,
         {_case_sql(POSTURES, "o_orderpriority", "unknown")} AS posture, 'model-' || (o_custkey % 3) AS model,
         {_case_sql(ROLES, "c_mktsegment", "")} AS role
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
METHODS_SQL = f"""methods AS (
  SELECT l_orderkey AS row_ord, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS m_pos,
         CASE WHEN l_returnflag = 'A' THEN 'adjudicated' WHEN l_returnflag = 'R' THEN 'alleged'
              WHEN l_linestatus = 'F' THEN 'admitted' ELSE 'reported' END AS claim_status,
         l_linenumber % 4 <> 0 AS has_quote,
         CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN true WHEN l_partkey % 3 = 1 THEN false END AS verbatim,
         {THEMES}[(n - 1) % 5 + 1] || lpad(CAST((n - 1) // 5 + 1 AS VARCHAR), 3, '0') AS technique, p_name AS action,
         CASE WHEN trim(coalesce(p_type, '')) = '' THEN 'unspecified'
              {" ".join(f"WHEN contains(upper(p_type), '{w}') THEN '{f}'" for w, f in FAMILIES)}
              ELSE lower(substr(p_type, 1, 80)) END AS family,
         CASE WHEN p_size % 9 < 8 THEN {OBSERVED_CHANNELS}[p_size % 9 + 1] END AS channel,
         CASE WHEN l_linenumber % 2 = 1 THEN 'mechanically_implied' ELSE 'analyst_inference' END AS basis, coalesce(p_type, '') AS artifact
  FROM lineitem JOIN (SELECT *, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS n FROM part) ON l_partkey = p_partkey)"""

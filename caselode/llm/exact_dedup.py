"""Exact deduplication by 128-bit content hash, verified byte for byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stage_table


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    content_hash: Callable[[Column], Column] = _md5,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit hash of the text (16 bytes a row are
    shuffled, pre-aggregated in each task). A hash that one row has needs no
    more work. Rows of the other hashes are regrouped by (hash, text), where
    the comparison of the grouping key is the comparison of bytes, so texts
    that collide end in groups of their own. Where a hash has one text only,
    rows find their group by the hash, else by hash and text. Copies are
    combined before the shuffle, and the joins with the rows deal groups of
    very many copies over several tasks.

    Defined cases: a null text counts as empty; null ids never win over
    others, and a group of null ids only keeps one row (keep_id null); of
    rows with the same text and the same winning id exactly one is kept;
    other columns of docs are ignored, whatever their names; an empty table
    gives an empty result. keep="max" keeps the largest id, "min" the smallest.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", content_hash(F.col("text")))
    groups = rows.select("doc_id", "h", F.sha2("text", 256).alias("sha")).groupBy("h").agg(
        best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.max("sha").alias("sha")
    )
    single = groups.where("n = 1").select(
        F.col("keep_id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    many = stage_table(groups.where("n > 1").select("h", F.col("n").alias("n_rows")), "hashes")
    shared = spread_join(rows, many, ["h"], "n_rows", ["doc_id"])
    texts = shared.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    digests = texts.select("h", "keep_id", "n", F.sha2("text", 256).alias("text_sha256"))
    by_hash = stage_table(digests, "groups").groupBy("h").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.max("text_sha256").alias("text_sha256")
    )
    by_hash = stage_table(by_hash, "hash-groups")
    columns = ["doc_id", "keep_id", F.col("n").alias("group_size"), "text_sha256"]
    members = spread_join(rows.select("doc_id", "h"), by_hash.where("texts = 1"), ["h"], "n", ["doc_id"]).select(*columns)
    if by_hash.where("texts > 1").limit(1).count():  # collisions
        collided = shared.join(by_hash.where("texts > 1").select("h"), "h", "left_semi")
        each = collided.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        members = members.unionByName(collided.join(each, ["h", "text"]).withColumn("text_sha256", F.sha2("text", 256)).select(*columns))
    # The window's key holds the id, so its groups are rows that repeat one id: of these one is kept.
    nth = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("keep_id"))
    members = members.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1))
    return single.unionByName(members.select(single.columns))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Defined cases: a null text counts as empty, so of null and empty texts one
    row stays; null ids never win over others; of rows that repeat the winning
    id and the text one stays; ids that repeat with different texts stand for
    as many texts; an empty table gives an empty result; columns keep their names.
    """
    id_key = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    kept = exact_dedup(docs, id_col=id_col, text_col=text_col, keep=keep).where("kept")
    kept = kept.select(id_key(F.col("doc_id")).alias("__dedup_id"), F.col("text_sha256").alias("__dedup_sha"))
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    keyed = docs.withColumns({"__dedup_id": id_key(docs[id_col]), "__dedup_sha": sha})
    nth = F.row_number().over(Window.partitionBy("__dedup_id", "__dedup_sha").orderBy("__dedup_id"))
    whole = keyed.join(kept, ["__dedup_id", "__dedup_sha"], "left_semi").withColumn("__dedup_nth", nth)
    return whole.where("__dedup_nth = 1").select(*[whole[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
             sha256(coalesce(text, '')) AS text_sha256
      FROM documents WINDOW g AS (PARTITION BY coalesce(text, '')))
"""

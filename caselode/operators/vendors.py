"""Vendor mentions in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselode.operators.lexicon import Lexicon
from caselode.operators.lexicon import mentions as lexicon_mentions


def mentions(rows: DataFrame, vendors: list[tuple[str, str, list[str]]] | DataFrame) -> DataFrame:
    """rows with (category, vendor) for each vendor that a text names, once a row and home.

    A text is scanned once, from left to right, for all aliases between
    characters other than a-z and 0-9, the longest first at each place; what
    it covers is used up. An alias may belong to vendors of several
    categories. vendors is a list of (category, vendor, aliases) or a table
    (category, vendor, alias).
    """
    if isinstance(vendors, list):
        lexicon = Lexicon.of_list([(f"{c} {v}", " ".join(a.split()), c, v) for c, v, al in vendors for a in al], ["category", "vendor"], least=1)
    else:
        plain = F.trim(F.regexp_replace("alias", r"\s+", " ")).alias("alias")
        homes = vendors.select("category", "vendor", plain, F.concat_ws(" ", "category", "vendor").alias("home")).distinct()
        lexicon = Lexicon.of_table(homes, group="home", alias="alias", payload=["category", "vendor"], least=1)
    found = F.array_distinct(lexicon_mentions(rows, F.lower("text"), lexicon))
    return rows.select("*", F.inline(found)).dropDuplicates(["category", "vendor", "link"])


def mention_counts(named: DataFrame) -> DataFrame:
    return named.groupBy("category", "vendor").agg(
        F.count_distinct("link").alias("total"), F.count_distinct(F.when(F.col("verdict"), F.col("link"))).alias("verdict_true")
    )


def receipts(named: DataFrame, *, order: list[Column], n: int = 25) -> DataFrame:
    """The first n rows of each vendor, and how many more there are."""
    by = Window.partitionBy("category", "vendor")
    sizes = named.groupBy("category", "vendor").agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more_cases"))
    top = named.withColumn("nth", F.row_number().over(by.orderBy(*order, "link"))).where(F.col("nth") <= n)
    return top.join(sizes, ["category", "vendor"])


def directory(counts: DataFrame) -> DataFrame:
    """Vendors with several homes are merged by the largest count, never the sum."""
    return counts.groupBy("vendor").agg(
        F.max("total").alias("total"), F.max("verdict_true").alias("verdict_true"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")
    )

"""Nested histories rewritten in place, and the better of two generations of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from caselode.functions.text import plain_quote
from caselode.operators.matching import computed


def stamp_history(rows: DataFrame, body: str = "body", history: str = "history") -> DataFrame:
    """rows with each quote of each generation stamped anew against the body, and `changed`: whether a stamp is another one.

    history is an array of generations with an array `methods` of structs that
    hold quote and verbatim; all their other fields, and generations without
    methods, stay as they are. A quote that is blank has no stamp (null), one
    that stands in the body, after plain_quote, is verbatim. A null body holds
    nothing; a null history stays null and is not changed.
    """
    made = computed(rows, {"_plain": plain_quote(F.coalesce(F.col(body), F.lit("")))})

    def stamp(m: Column) -> Column:
        quote = plain_quote(m["quote"])
        return m.withField("verbatim", F.when(quote != "", F.contains(F.col("_plain"), quote)))

    new = F.transform(history, lambda g: g.withField("methods", F.transform(g["methods"], stamp)))
    made = computed(made, {"_new": new})
    changed = ~F.col(history).eqNullSafe(F.col("_new"))
    return made.withColumn("changed", changed).withColumn(history, F.col("_new")).select(*rows.columns, "changed")


def rewrite_changed(rows: DataFrame, path: str, body: str = "body", history: str = "history") -> int:
    """Write only the rows whose history changes, as a delta for a store that is merged when read; how many there are. One pass."""
    seen = Observation("history")
    stamped = stamp_history(rows, body, history).observe(seen, F.count_if("changed").alias("changed"))
    stamped.where("changed").drop("changed").write.mode("overwrite").parquet(path)
    return seen.get["changed"]


def keep_best(snapshot: DataFrame, current: DataFrame, key: str, richness: str) -> DataFrame:
    """The rows of current, and those of snapshot that are strictly richer in place of them, with `restored`.

    A key that only the snapshot has does not come back; one that only current
    has stays; of rows that repeat a key in the snapshot the richest counts. A
    null richness is the least.
    """
    others = [c for c in current.columns if c != key]
    rich = lambda c: F.coalesce(c, F.lit(float("-inf")).cast("double"))
    old = snapshot.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), rich(F.col(richness).cast("double"))).alias("_old"))
    both = current.join(old, key, "left")
    better = F.col("_old").isNotNull() & (rich(F.col(f"_old.{richness}").cast("double")) > rich(F.col(richness).cast("double")))
    return both.select(key, *[F.when(better, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) for c in others], better.alias("restored")).select(*current.columns, "restored")

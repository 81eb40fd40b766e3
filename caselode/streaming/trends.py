"""Trends that roll: one sketch of distinct stories for each key and day, merged over windows of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch, as a power of two; the relative standard error is about 1.04 / sqrt(2 ** LG_K), here 1.6 %.
LG_K = 12


def daily_sketches(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, key, sketch): the distinct stories of each key and day, of a stream or a table (key, story, stamp).

    A stream gives a day once its watermark has passed the day's end; what it
    keeps is one sketch for each key and open day. Rows later than `late`
    behind the newest are dropped. Null stories count for nothing.
    """
    found = rows.withWatermark("stamp", late) if rows.isStreaming else rows
    days = found.groupBy(F.window("stamp", "1 day").alias("w"), "key").agg(F.hll_sketch_agg(F.col("story").cast("string"), F.lit(LG_K)).alias("sketch"))
    return days.select(F.to_date("w.start").alias("day"), "key", "sketch")


def _windows(days: DataFrame, width: int) -> DataFrame:
    """days with `back`, how many windows of `width` days they lie before the newest day; the newest window is 0."""
    newest = days.agg(F.max("day").alias("newest"))
    placed = days.crossJoin(F.broadcast(newest))  # one row
    return placed.withColumn("back", F.floor(F.date_diff("newest", "day") / width)).drop("newest")


def _changes(counts: DataFrame) -> DataFrame:
    recent, prior = F.col("recent"), F.col("prior")
    delta = F.when(prior > 0, F.bround((recent - prior) * 100.0 / prior, 1)).alias("delta_pct")
    direction = F.when((prior == 0) & (recent > 0), "new").when(recent > prior, "up").when(recent < prior, "down").otherwise("flat")
    return counts.select("key", "recent", "prior", delta, direction.alias("direction"))


def rolling(sketches: DataFrame, width: int = 7) -> DataFrame:
    """(key, recent, prior, delta_pct, direction): estimated distinct stories of the last `width` days and of those before.

    Only the sketches of two windows are read and merged, and no event again;
    the next day's trends take one day more and drop one. The newest day is
    that of the sketches.
    """
    two = _windows(sketches, width).where("back < 2")
    merged = lambda back: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.when(F.col("back") == back, F.col("sketch")))), F.lit(0)).cast("long")
    return _changes(two.groupBy("key").agg(merged(0).alias("recent"), merged(1).alias("prior")))


def rolling_exact(days: DataFrame, width: int = 7) -> DataFrame:
    """The same, counted: from distinct (day, key, story), for checks and for keys of few stories."""
    two = _windows(days.where("story is not null"), width).where("back < 2")
    count = lambda back: F.count_distinct(F.when(F.col("back") == back, F.col("story")))
    return _changes(two.groupBy("key").agg(count(0).alias("recent"), count(1).alias("prior")))

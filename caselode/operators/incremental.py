"""Stores, merges, generations, budgets and selections that nightly runs need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselode.sources import shared


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; its place is that of the key's first row."""
    first, last = F.min(F.struct(*order)), F.max(F.struct(*order, *[c for c in rows.columns if c not in (key, *order)]))
    kept = rows.groupBy(key).agg(last.alias("last"), first.alias("first"))
    return kept.select(key, "last.*", F.col(f"first.{order[0]}").alias("first_place"))


def append_new(store: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose key the store doesn't know, the first of each by `order`."""
    new = rows.join(store.select(key), key, "left_anti")
    others = F.struct(*[c for c in rows.columns if c != key])
    return new.groupBy(key).agg(F.min_by(others, F.struct(*order)).alias("_first")).select(key, "_first.*").select(*rows.columns)


def fingerprint(title: Column, summary: Column) -> Column:
    return F.sha1(F.concat(F.coalesce(title, F.lit("")), F.lit("\x1f"), F.coalesce(summary, F.lit(""))))


def merge_refresh(store: DataFrame, incoming: DataFrame, force: bool = False, derived: tuple[str, ...] = ()) -> DataFrame:
    """link, action, content and the derived columns after a merge: new links are inserted; known ones are
    replaced if title or summary changed, a body appears, or force is set, and kept otherwise.

    What is replaced loses the columns that were derived from the old text.
    """
    s = store.select("link", *[F.col(c).alias(f"old_{c}") for c in ("title", "summary", "content")], *derived)
    changed = fingerprint(F.col("title"), F.col("summary")) != fingerprint(F.col("old_title"), F.col("old_summary"))
    body = (F.coalesce("old_content", F.lit("")) == "") & (F.coalesce("content", F.lit("")) != "")
    new = incoming.select("link", "title", "summary", "content").withColumn("came", F.lit(True))
    both = new.join(s.withColumn("known", F.lit(True)), "link", "full_outer")
    action = F.when(F.col("came").isNull(), "kept").when(F.col("known").isNull(), "inserted").when(changed | body | F.lit(force), "replaced").otherwise("kept")
    kept = F.col("action") == "kept"
    return both.withColumn("action", action).select(
        "link", "action", F.when(kept, F.col("old_content")).otherwise(F.col("content")).alias("content"), *[F.when(kept, F.col(c)).alias(c) for c in derived]
    )


def numbered(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """rows with `nth`, their place among those of the same `by`, without one task for each `by`.

    Rows are dealt out by range of by and order; a place is the place in the
    range and the sum of the ranges before it, of which there is one row each.
    The ranges are written once, as two passes over the rows could cut them
    in different places.
    """
    spark, path = rows.sparkSession, shared.fresh_path(rows.sparkSession, "ranges")
    ranges = rows.repartitionByRange(F.col(by), *order).withColumn("_range", F.spark_partition_id())
    ranges.write.parquet(path)
    ranges = spark.read.schema(ranges.schema).parquet(path)
    so_far = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = ranges.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n")).select(by, "_range", so_far.alias("_before"))
    inside = ranges.withColumn("_inside", F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)))
    placed = inside.join(before, [by, "_range"]).withColumn("nth", (F.col("_before") + F.col("_inside")).cast("int"))
    return placed.select(*rows.columns, "nth")


def stale_rows(raw: DataFrame, done: DataFrame) -> DataFrame:
    """Raw rows without a processed row, or ingested after it; filings first, newest first."""
    prior = done.select("link", F.col("processed_at").alias("prior_at"))
    todo = raw.join(prior, "link", "left").where(F.col("prior_at").isNull() | (F.col("prior_at") < F.col("ingested_at")))
    return numbered(todo, "channel", [F.desc_nulls_last("published"), F.col("row_ord").asc()])


def richness() -> Column:
    return 100 * F.col("has_note").cast("int") + 10 * F.col("n_methods") + F.col("confidence")


def best_generation(history: DataFrame) -> DataFrame:
    """One generation of each link: the newest schema tier, then the richest of each
    verdict, then the most confident; ties by richness, then the later one."""
    tier = history.groupBy("link").agg(F.max("schema").alias("top"))
    newest = history.join(tier, "link").where("schema = top")
    rank = F.struct(richness().alias("rich"), F.col("gen"))
    columns = F.struct("gen", "schema", "verdict", "confidence", "n_methods", "has_note")
    per_verdict = newest.groupBy("link", "verdict").agg(F.max_by(columns, rank).alias("g")).select("link", "g.*")
    best = F.struct(F.col("confidence"), richness().alias("rich"), F.col("gen"))
    return per_verdict.groupBy("link").agg(F.max_by(F.struct("gen", "verdict", "confidence"), best).alias("g")).select("link", "g.*")


def append_generations(history: DataFrame, new: DataFrame) -> DataFrame:
    """New generations whose (schema, verdict, methods, note, confidence to four places) no stored one of the link has."""
    sign = lambda df: df.withColumn("c4", F.bround("confidence", 4))
    on = ["link", "schema", "verdict", "n_methods", "has_note", "c4"]
    return sign(new).join(sign(history).select(on), on, "left_anti").drop("c4")


def budget_prefix(rows: DataFrame, key: str, order: list[str], cost: int, budget: int, cap: int) -> DataFrame:
    """Rows of each key, in order, while their summed cost is within the budget, at most cap."""
    w = Window.partitionBy(key).orderBy(*order)
    spent = F.sum(F.lit(cost)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).withColumn("nth", F.row_number().over(w)).where((F.col("spent") <= budget) & (F.col("nth") <= cap))


def concat_within(rows: DataFrame, key: str, order: str, text: str, cap: int) -> DataFrame:
    """Texts of each key in order, joined by line ends and cut where their running length passes cap."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))
    part = F.substring(F.col(text), F.lit(1), F.greatest(F.lit(cap) - F.col("before"), F.lit(0)).cast("int"))
    kept = rows.withColumn("before", before).where(F.col("before") < cap).select(key, order, part.alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "part"))), lambda s: s["part"])
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.array_join(parts, "\n").alias("joined"))


def round_robin_sample(rows: DataFrame, cell: list[str], verdict: str, key: str, seed: int, n: int) -> DataFrame:
    """n rows by turns of verdict, and within a verdict by turns of cell, in hash order.

    Two row numbers give what a cursor over cells would: the place in the cell, then in the verdict.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    name = F.concat_ws("|", *cell)
    rows = rows.withColumn("h", h).withColumn("cell", name)
    # the n first of a cell come before all others of their verdict, so more can't be among the n first
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("cell", verdict).orderBy("h", key))).where(F.col("r") <= n)
    by = Window.partitionBy(verdict).orderBy("r", F.sha2("cell", 256), "cell")
    return rows.withColumn("k", F.row_number().over(by)).where(F.col("k") <= n).orderBy("k", F.desc(verdict)).limit(n)


def failure_runs(cycles: DataFrame) -> DataFrame:
    """(lane, cycle, outcome) with the run of failures that ends at each cycle.

    A success resets it; a skipped cycle carries it on. Runs are islands
    between successes: no row-by-row state.
    """
    w = Window.partitionBy("lane").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum((F.col("outcome") == "ok").cast("int")).over(w)
    inside = Window.partitionBy("lane", "island").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    return cycles.withColumn("island", island).withColumn("failures", F.sum((F.col("outcome") == "failed").cast("int")).over(inside)).drop("island")


def sessions(rows: DataFrame, key: str, stamp: str, gap_seconds: int) -> DataFrame:
    """Sessions of each key: a new one begins after more than the gap."""
    w = Window.partitionBy(key).orderBy(stamp)
    new = F.coalesce((F.unix_micros(stamp) - F.unix_micros(F.lag(stamp).over(w)) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = rows.withColumn("new", new)
    nth = F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("nth", nth).groupBy(key, "nth").agg(F.count(F.lit(1)).alias("events"), F.min(stamp).alias("opened"), F.max(stamp).alias("closed"))


def admitted(rows: DataFrame, key: str, limit: int, window_seconds: int) -> DataFrame:
    """Requests that a sliding window admits; denied ones don't count against it.

    Whether a request passes depends on the verdicts before it, so each key's
    requests are read in order, batch by batch. All that is kept is the stamps
    that the key at hand admitted last, at most `limit`.
    """
    span = window_seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = object(), []
        for pdf in batches:
            keep = []
            for k, t in zip(pdf[key], pdf["t"], strict=True):
                if k != current:
                    current, recent = k, []
                recent = [x for x in recent if t - x < span]
                keep.append(len(recent) < limit)
                if keep[-1]:
                    recent.append(t)
            yield pdf.assign(admitted=keep)[[key, "event_id", "admitted"]]

    small = rows.select(key, "event_id", F.unix_micros("ts").alias("t")).where(F.col(key).isNotNull())
    ordered = small.repartition(key).sortWithinPartitions(key, "t", "event_id")
    return ordered.mapInPandas(run, f"{key} long, event_id long, admitted boolean")


def leader_clusters(vectors: DataFrame, threshold: float, bucket: Column) -> DataFrame:
    """Greedy leader clustering inside each bucket, in id order: a vector joins the
    nearest centroid of cosine >= threshold (ties to the later), else founds a cluster.

    The result depends on the order, so a bucket is read in one task, batch by
    batch; what is kept of it are its centroids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sums, units, n = None, np.empty((0, 0)), np.empty((0, 0)), 0
        for pdf in batches:
            names = []
            for b, x in zip(pdf["bucket"], pdf["embedding"], strict=True):
                x = np.asarray(x, float)
                x = x / (np.linalg.norm(x) or 1)
                if b != current:
                    current, n = b, 0
                    sums, units = np.zeros((16, len(x))), np.zeros((16, len(x)))
                cos = units[:n] @ x
                at = n - 1 - int(cos[::-1].argmax()) if n and cos.max() >= threshold else n
                if at == n:
                    n += 1
                    if n > len(sums):
                        sums, units = (np.concatenate((m, np.zeros_like(m))) for m in (sums, units))
                sums[at] += x
                units[at] = sums[at] / (np.linalg.norm(sums[at]) or 1)
                names.append(at)
            yield pdf[["bucket", "vec_id"]].assign(cluster=names)

    rows = vectors.select(bucket.cast("long").alias("bucket"), "vec_id", "embedding")
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "vec_id")
    return ordered.mapInPandas(run, "bucket long, vec_id long, cluster long")

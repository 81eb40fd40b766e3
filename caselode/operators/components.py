"""Connected components by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.sources import shared


def _stage(df: DataFrame) -> DataFrame:
    path = shared.fresh_path(df.sparkSession, "component-edges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each node that has an edge to another: the smallest node reachable.

    Each round links a node to the smallest of its neighbours, for larger
    neighbours and then for smaller ones, until nothing changes. Edges are
    written after each round, so a lost executor costs a round at most. Null
    ends and loops are no edges.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("real"))
    now = _stage(ends.where("real").select("u", "v").distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = _stage(small.union(smallest).distinct())
        state, before = _state(now), state
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)

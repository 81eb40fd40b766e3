"""Clusters of similar vectors across all labels: hyperplane buckets, exact comparison, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.operators.components import components
from caselode.sources import shared


def _stage(df: DataFrame, name: str) -> DataFrame:
    path = shared.fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_for(rows: int, threshold: float, target: float, most: int = 64, bucket: int = 128) -> tuple[int, int]:
    """(bits, tables): as many bits as buckets of about `bucket` rows need, and so many tables that a pair at the
    threshold shares a bucket with probability `target`; fewer bits where that would take more than `most` tables."""
    same = 1 - math.acos(min(1.0, threshold)) / math.pi  # of one bit
    for bits in range(max(1, min(30, math.ceil(math.log2(max(2, rows / bucket))))), 0, -1):
        miss = 1 - same**bits
        tables = 1 if miss <= 0 else math.ceil(math.log(1 - target) / math.log(miss))
        if tables <= most:
            return bits, tables
    return 1, most


def _unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, key, unit): vectors of length one, and a hash of them; without null, zero and non-finite ones."""
    found = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    found = found.where("vec_id is not null and size(v) > 0").where(fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = []
            for v in b.column(1):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), float)
                x = x / np.abs(x).max()
                units.append((x / np.linalg.norm(x) + 0.0).tobytes())
            keys = [hashlib.blake2b(u, digest_size=16).digest() for u in units]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "key", "unit"])

    return found.mapInArrow(run, "vec_id long, key binary, unit binary")


def forest(x: np.ndarray, threshold: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links (inner product at least the threshold) between the rows of x."""
    label = np.arange(len(x))
    for at in range(0, len(x), block):
        near = x[at : at + block] @ x.T >= threshold
        for i in range(len(near)):
            own = np.unique(label[np.flatnonzero(near[i])])
            own = np.union1d(own, label[[at + i]])
            if len(own) > 1:
                to = np.arange(len(x))
                to[own] = own[0]
                label = to[label]
    moved = np.flatnonzero(label != np.arange(len(x)))
    return moved, label[moved]


def links(classes: DataFrame, threshold: float, bits: int, tables: int, hot: int = 4096, seed: int = 0) -> DataFrame:
    """(a, b): keys of classes that stand in one bucket of a table and are similar; not all pairs, but a forest of them
    for each group that is compared.

    Buckets of more than `hot` rows are dealt out in a grid: rows get one of
    several parts, and each two parts meet in a group of their own, so no task
    holds more than twice `hot` rows at once and no pair is left out.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            size = np.array([len(u) for u in b.column(1).to_pylist()])
            for width in np.unique(size // 8).tolist():
                at = np.flatnonzero(size == width * 8)
                x = np.frombuffer(b"".join(b.column(1).take(pa.array(at)).to_pylist())).reshape(-1, width)
                if width not in planes:
                    planes[width] = np.random.default_rng([seed, width]).normal(size=(tables * bits, width))
                codes = ((x @ planes[width].T > 0).reshape(len(x), tables, bits) * weight).sum(axis=2)
                own = b.take(pa.array(at))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(np.full(len(x), width, np.int32)), pa.array(codes[:, t]), *own.columns], ["t", "width", "code", "key", "unit"])

    placed = classes.select("key", "unit").mapInArrow(place, "t int, width int, code long, key binary, unit binary")
    bucket = ["t", "width", "code"]
    counts = _stage(placed.groupBy(*bucket).count().where("count > 1"), "similar-buckets")
    parts = F.ceil(F.col("count") / hot).cast("int")
    dealt = placed.join(counts, bucket).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    meet = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")
    dealt = dealt.select(*bucket, "key", "unit", "own", meet).select(*bucket, "key", "unit", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        keys = table["key"].to_pylist()
        a, b = forest(np.frombuffer(b"".join(table["unit"].to_pylist())).reshape(len(keys), -1), threshold)
        return pa.table({"a": pa.array([keys[i] for i in a], pa.binary()), "b": pa.array([keys[i] for i in b], pa.binary())})

    return dealt.groupBy(*bucket, "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def similar_clusters(vectors: DataFrame, threshold: float, *, id_col: str = "vec_id", vector_col: str = "embedding", target: float = 0.95, most_tables: int = 64, bucket: int = 128, hot: int = 4096) -> DataFrame:
    """(vec_id, cluster, size): the connected components of vectors of cosine `threshold` and more, whatever their labels.

    Candidates come from hyperplane buckets in several tables, candidates are
    compared exactly, so no link is wrong; a pair exactly at the threshold is
    met with probability `target`, more similar ones with a larger one, and a
    component is found whole where the links that are met connect it. cluster
    is the smallest vec_id of the component.

    Defined cases: vectors that are null, zero, empty or not finite, and null
    ids take no part; equal vectors are one class, compared once; vectors of
    several lengths meet those of their own; rows that repeat stay; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = _stage(_unit_rows(vectors, id_col, vector_col), "similar-rows")
    classes = _stage(rows.groupBy("key").agg(F.first("unit").alias("unit"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "similar-classes")
    bits, tables = tables_for(classes.count(), threshold, target, most_tables, bucket)
    roots = components(links(classes, threshold, bits, tables, hot))
    rooted = classes.join(roots, classes["key"] == roots["node"], "left").select("key", "first_id", "n", F.coalesce("component", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("cluster"), F.sum("n").alias("size"))
    known = rooted.join(named, "root").select("key", "cluster", "size")
    return rows.select("vec_id", "key").join(known, "key").select("vec_id", "cluster", "size")

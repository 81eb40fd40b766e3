"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the five ASCII controls \t \n \v \f \r.
#: bytes.split() without an argument splits on exactly these six bytes.
WORD_RE = r"[^\x20\x09-\x0D]+"

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share.

    It is spark.checkpoint.dir when the session has it. Otherwise a local
    session (tests on one machine) gets a temporary folder, which is made once
    and set for the session, and a session on a cluster is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="caselode-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df in the shared folder and read it back: lineage ends in files
    that outlive any executor. The shuffle files that led to the table are
    freed when it is written. by: a column whose values get folders of their
    own, so that a filter on it reads only those."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def drop_table(table: DataFrame) -> None:
    """Remove the files of a table of stage_table that nothing reads any more; other DataFrames are left alone."""
    path, spark = getattr(table, "_staged_at", None), table.sparkSession
    if path:
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)


def planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, those of equal weight next to each other, which compression makes small."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.empty(0, kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def crc32_mod(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod. A null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], count: str, by: list[str], parts: int = 1000) -> DataFrame:
    """left joined with right (one row a key) on equal keys, with keys that many rows share dealt over several tasks.

    `count` names right's number of left rows with the key; `right` is read
    twice, so it should be a table. A key with more than 1/parts of all rows
    (and more than 1,000) is hot: there are fewer than `parts` of them, so the
    list that is broadcast is bounded. Rows of a hot key get one of several
    salts by the hash of their columns `by`, and right's row is repeated for each.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    limit = max(1000, total // parts)
    salts = F.ceil(F.col(count) / limit).cast("int")
    hot = right.where(F.col(count) > limit).select(*on, salts.alias("__salts"))
    dealt = left.join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), "__salts").cast("int"))).drop("__salts")
    each = right.withColumn("__salt", F.explode(F.when(F.col(count) > limit, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(each, [*on, "__salt"]).drop("__salt")

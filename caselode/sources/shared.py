"""Files in the folder that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session has it. A local session without it gets a temporary folder, set once; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="caselode-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Paths that this driver handed out, for clean_up.
_handed: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _handed.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _handed[-1]


def clean_up(spark: SparkSession) -> int:
    """Remove what this driver has written in the shared folder so far; how many paths. Only when no result that reads them is still to be written."""
    n = len(_handed)
    while _handed:
        remove(spark, _handed.pop())
    return n


def _on(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _on(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if there is no folder."""
    fs, where = _on(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _on(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _on(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file in one step: under another name first, then renamed. False if the file is there already."""
    fs, where = _on(spark, path)
    _, draft = _on(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.exists(where) and fs.rename(draft, where):
        return True
    fs.delete(draft, False)
    return False

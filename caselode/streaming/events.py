"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as a file stream, stamps as UTC timestamps."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def first_seen(rows: DataFrame, key: str, late: str = "3 days") -> DataFrame:
    """Rows whose key was not seen within the watermark: link dedupe across runs."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is, into parquet under `path`, and read the result."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def admit(rows: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """The sliding admit limiter with state: each user's last admitted stamps, at most `limit`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, keep = list(state.get[0]) if state.exists else [], []
        pdf = pd.concat(batches).sort_values(["t", "event_id"])  # a key's rows of one micro-batch, whatever Arrow batches they come in
        for t in pdf["t"]:
            recent = [x for x in recent if t - x < window_seconds * 1_000_000]
            keep.append(len(recent) < limit)
            if keep[-1]:
                recent.append(t)
        state.update((recent,))
        yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "admitted": keep})

    small = rows.select("user_id", "event_id", F.unix_micros("ts").alias("t"))
    return small.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, admitted boolean", "recent array<long>", "append", GroupStateTimeout.NoTimeout
    )


def failure_counts(cycles: DataFrame) -> DataFrame:
    """Consecutive failures of each lane with state: a success resets, a skipped cycle carries on."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (run,) = state.get if state.exists else (0,)
        pdf, out = pd.concat(batches).sort_values("cycle"), []
        for outcome in pdf["outcome"]:
            run = 0 if outcome == "ok" else run + (outcome == "failed")
            out.append(run)
        state.update((run,))
        yield pd.DataFrame({"lane": pdf["lane"], "cycle": pdf["cycle"], "failures": out})

    return cycles.groupBy("lane").applyInPandasWithState(step, "lane long, cycle long, failures long", "run long", "append", GroupStateTimeout.NoTimeout)

"""A backward sweep over history as a streaming source: its offset is a window of days and a slice of the queries."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "first_day date, last_day date, slice int, place int, query string"


def _day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


class SweepReader(SimpleDataSourceStreamReader):
    """Each batch is one slice of the queries for one window. The window's days move back only when all slices of the
    queries ran; while the file `throttled` is there, the offset stays and the batch is empty; at `floor` it ends."""

    def __init__(self, options: dict):
        self.queries = options["queries"].split("\n")
        self.per, self.days = int(options.get("per", "0")) or len(self.queries), int(options.get("days", "90"))
        self.newest, self.floor, self.throttled = options["newest"], _day(options["floor"]), options.get("throttled")

    def initialOffset(self) -> dict:
        return {"last_day": self.newest, "slice": 0}

    def _batch(self, at: dict) -> tuple[list[tuple], dict]:
        last = _day(at["last_day"])
        if last <= self.floor:
            return [], at
        first = max(self.floor, last - dt.timedelta(days=self.days))
        start = at["slice"] * self.per
        rows = [(first, last, at["slice"], start + i, q) for i, q in enumerate(self.queries[start : start + self.per])]
        if start + self.per < len(self.queries):
            return rows, {"last_day": at["last_day"], "slice": at["slice"] + 1}
        return rows, {"last_day": first.isoformat(), "slice": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.throttled and os.path.exists(self.throttled):
            return iter([]), start
        rows, end = self._batch(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows again, after a failure."""
        while start != end:
            rows, following = self._batch(start)
            yield from rows
            if following == start:
                return
            start = following


class HistorySweep(DataSource):
    """spark.readStream.format("history_sweep"): options queries (one a line), newest and floor (days), days, per, throttled (a file of the driver's machine)."""

    @classmethod
    def name(cls) -> str:
        return "history_sweep"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SweepReader:
        return SweepReader(self.options)


def gap_first(queries: list[str], covered: list[str]) -> list[str]:
    """The rotation: queries that earlier sweeps left out go first."""
    return [q for q in queries if q not in covered] + [q for q in queries if q in covered]


def sweep(spark: SparkSession, queries: list[str], newest: str, floor: str, *, days: int = 90, per: int = 0, throttled: str | None = None) -> DataFrame:
    """The stream of requests (first_day, last_day, slice, place, query); days count from first_day, which is left out, to last_day."""
    spark.dataSource.register(HistorySweep)
    options = {"queries": "\n".join(queries), "newest": newest, "floor": floor, "days": str(days), "per": str(per)}
    return spark.readStream.format("history_sweep").options(**options, **({"throttled": throttled} if throttled else {})).load()


def run_once(stream: DataFrame, path: str) -> None:
    """One run: the next slice, if there is one and nothing throttles it. path keeps the cursor and the requests made."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/cursor").option("path", f"{path}/requests").trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_the_floor(stream: DataFrame, path: str, seconds: int = 600) -> DataFrame:
    """Run slice after slice until the sweep is at its floor; all requests made so far."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/cursor").option("path", f"{path}/requests").trigger(processingTime="0 seconds").start()
    try:
        for _ in range(seconds * 2):
            if not query.isActive:
                break
            query.processAllAvailable()
            if not query.status["isDataAvailable"]:
                break
    finally:
        query.stop()
    return stream.sparkSession.read.schema(SCHEMA).parquet(f"{path}/requests").select(*[F.col(f.split()[0]) for f in SCHEMA.split(", ")])

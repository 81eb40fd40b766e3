"""Sketches that roll against exact counts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from caselode.streaming import events as E
from caselode.streaming import trends as T

KIND = "key string, story string, stamp timestamp"


def test_error_bound_of_merged_days(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id") % 2).alias("key"), (F.col("id") * 7 % 60_000).cast("string").alias("story"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 6).alias("stamp"))
    days = rows.select(F.to_date("stamp").alias("day"), "key", "story").distinct()
    exact = {r.key: r for r in T.rolling_exact(days).collect()}
    for r in T.rolling(T.daily_sketches(rows)).collect():
        for field in ("recent", "prior"):
            assert abs(r[field] - exact[r.key][field]) <= 0.05 * exact[r.key][field]


def test_a_new_day_rolls_without_the_old_events(spark, tmp_path):
    rnd, day0 = random.Random(1), dt.datetime(2024, 1, 1)
    every = []
    for d in range(18):
        rows = [(rnd.choice(["a", "b"]), rnd.choice([None, *"stuvwxyz"]), day0 + dt.timedelta(days=d, minutes=rnd.randint(0, 1400))) for _ in range(12)]
        every += rows
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / f"in/day={d:02}"))
        if d in (9, 13, 17):  # three runs of one stream
            stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in/*"))
            sketches = E.drain(T.daily_sketches(stream), str(tmp_path / "out"))
            last = max(r.day for r in sketches.select("day").collect())
            assert last == (day0 + dt.timedelta(days=d - 1)).date()  # the newest day is still open
            want = {}
            for key, story, stamp in every:
                if story and (back := (last - stamp.date()).days // 7) in (0, 1):
                    want.setdefault(key, (set(), set()))[back].add(story)
            got = {r.key: (r.recent, r.prior) for r in T.rolling(sketches).collect()}
            assert got == {k: tuple(map(len, v)) for k, v in want.items()}
            assert sketches.count() == sketches.select("day", "key").distinct().count()

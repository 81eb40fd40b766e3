"""The versioned store across failures, and clocks whose state ends."""

import os
import random

import pytest

from caselode.operators.incremental import last_wins
from caselode.sources import shared
from caselode.streaming import clocks, store

SCHEMA = "link string, n long, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


@pytest.fixture
def kept(spark, tmp_path):
    return store.VersionedStore(spark, f"file://{tmp_path}/s", SCHEMA, "link", ["n"])


def test_reads_are_the_last_rows(spark, kept):
    rnd, every = random.Random(1), []
    assert rows(kept.read()) == []
    for number in range(5):
        batch = [(rnd.choice(["a", "b", "c", None, f"x{number}"]), number * 10 + i, f"t{i}") for i in range(8)]
        every += batch
        assert kept.append(spark.createDataFrame(batch, SCHEMA), number)
        assert rows(kept.read()) == rows(last_wins(spark.createDataFrame(every, SCHEMA), "link", ["n"]).select("link", "n", "text"))
    before = rows(kept.read())
    assert not kept.append(spark.createDataFrame([("a", 10**6, "again")], SCHEMA), 4)
    kept.compact()
    assert rows(kept.read()) == before and len(kept.manifest()["live"]) == 1 and kept.manifest()["batch"] == 4
    assert len(kept.vacuum()) == 5 and rows(kept.read()) == before


def test_a_crash_before_the_swap_loses_nothing(spark, kept, monkeypatch):
    kept.append(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    for step in (lambda: kept.append(spark.createDataFrame([("a", 2, "y")], SCHEMA), 1), kept.compact):
        before, at = rows(kept.read()), kept.version()
        with monkeypatch.context() as m:
            m.setattr(shared, "create_text", lambda *a: (_ for _ in ()).throw(OSError("killed")))
            if len(kept.manifest()["live"]) > 1 or step is not kept.compact:
                with pytest.raises(OSError):
                    step()
        assert rows(kept.read()) == before and kept.version() == at
        step()
    assert rows(kept.read()) == [("a", 2, "y")]
    kept.vacuum()
    assert rows(kept.read()) == [("a", 2, "y")]


def test_two_writers_cannot_swap_one_version(spark, kept):
    kept.append(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    with pytest.raises(store.Conflict):
        kept._swap(1, {"live": [], "batch": 9})
    assert rows(kept.read()) == [("a", 1, "x")]


def test_a_batch_costs_what_it_holds(spark, tmp_path, kept):
    wide = spark.range(20_000).selectExpr("cast(id as string) link", "id n", "sha2(cast(id as string), 256) text")
    kept.append(wide)
    before = size(tmp_path)
    kept.append(spark.createDataFrame([("7", 10**6, "new")], SCHEMA))
    assert size(tmp_path) - before < before / 50
    assert kept.read().where("link = '7'").first().text == "new" and kept.read().count() == 20_000


def test_streams_of_several_batches(spark, tmp_path, kept):
    for i in range(4):
        spark.createDataFrame([("a", i, f"t{i}"), (f"k{i}", i, "u")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        store.upsert_stream(stream, kept, f"file://{tmp_path}/check", compact_every=2)
        assert rows(kept.read()) == [("a", 3, "t3"), *((f"k{i}", i, "u") for i in range(4))]
        assert len(kept.manifest()["live"]) <= 2 and kept.manifest()["batch"] == 3


def plain_clock(asks, every):
    state, out = {}, []
    for link, t, nth, genuine, ended in sorted(asks, key=lambda a: (a[1], a[2])):
        last, over = state.get(link, (None, False))
        due = not over and (last is None or t - last >= every)
        state[link] = (t if due and genuine else last, over or (due and ended))
        out.append((link, t, nth, due))
    return sorted(out, key=repr)


ASKS = "link string, t long, nth long, genuine boolean, ended boolean"


def test_clocks_end(spark, tmp_path):
    rnd = random.Random(2)
    every, batches = 100, []
    for b in range(6):
        batches.append([(rnd.choice(["a", "b", f"only{b}", None]), b * 200 + rnd.randint(0, 199), b * 100 + i, rnd.random() < 0.7, rnd.random() < 0.05) for i in range(30)])
    done, held = [], []
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, ASKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ASKS).parquet(str(tmp_path / "in"))
        query = clocks.due_checks(stream, every, 10**6).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out"))
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(max((p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators), default=0))
        done += batch
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == plain_clock(done, every)
    keys = {a[0] for b in batches for a in b}
    last = []
    for i in range(2):  # the watermark passes all timers
        spark.createDataFrame([("z", 10_000_000 + i, 0, False, False)], ASKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = clocks.due_checks(spark.readStream.schema(ASKS).parquet(str(tmp_path / "in")), every, 1000).writeStream.format("parquet")
        query = query.option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
        last += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(keys) > 6 and max(held) > 0 and last[-1] == 0

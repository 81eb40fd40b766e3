"""Clocks of keys whose state ends: timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState keeps its state in RocksDB.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Recheck(StatefulProcessor):
    """One clock a link.

    A genuine check starts the clock; until `every` seconds later the link is
    not due, and then the clock's state goes, as no state and a clock that ran
    down mean the same. A link that ended stays known for `forget` seconds
    after it was last asked for.
    """

    def __init__(self, every: int, forget: int):
        self.every, self.forget = every, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "last long, over boolean")

    def _until(self, t: int) -> None:
        """One timer: when this link's state may go."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(t * 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, over = self.clock.get() if self.clock.exists() else (None, False)
        asks = sorted((r.t, r.nth, r.genuine, r.ended) for r in rows)
        for t, nth, genuine, ended in asks:
            due = not over and (last is None or t - last >= self.every)
            if due and genuine:
                last = t
            over = over or bool(due and ended)
            yield Row(link=key[0], t=t, nth=nth, due=due)
        if over:
            self.clock.update((last, over))
            self._until(asks[-1][0] + self.forget)
        elif last is not None:
            self.clock.update((last, over))
            self._until(last + self.every)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.clock.clear()
        yield from ()

    def close(self) -> None:
        pass


def due_checks(asks: DataFrame, every: int, forget: int, late: str = "0 seconds") -> DataFrame:
    """(link, t, nth, genuine, ended) to (link, t, nth, due): whether a link is to be checked when it is asked for at t (seconds).

    A link is due unless its last genuine check is less than `every` seconds
    old; a check that was not genuine (a throttled one) starts no clock; a
    link that ended is not due again, until it was not asked for in `forget`
    seconds. Asks of one time go in the order of nth. Asks that come later
    than `late` behind the newest are dropped, and those of t <= 0. A null link is a link.
    """
    asks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = asks.select("link", "t", "nth", "genuine", "ended", F.timestamp_seconds("t").alias("at")).withWatermark("at", late)
    kind = dict(asks.dtypes)
    return rows.groupBy("link").transformWithState(
        Recheck(every, forget), f"link {kind['link']}, t long, nth long, due boolean", "append", "EventTime"
    )

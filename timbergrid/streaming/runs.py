"""Runs of days on a stream: what ``runs_at_least`` gives for a whole record, told as soon as a run can't grow any more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from timbergrid.operators.checkpoints import ship

DAY_MS = 86_400_000


class OpenRuns(StatefulProcessor):
    """A station's days that the watermark hasn't passed yet, and the run that its last passed day belongs to.

    Days wait until the watermark is past them, whatever their order; then they are taken in order, and a day without
    the flag ends the run before it. A timer wakes a station of which nothing comes any more.
    """

    def __init__(self, least: int) -> None:
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day long", "flag boolean")
        self.run = handle.getValueState("run", "first long, last long, days long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ts, flag in zip(part["ts"], part["flag"], strict=True):
                day = int(ts.timestamp() * 1000)
                held = self.waiting.containsKey((day,)) and self.waiting.getValue((day,))[0]
                self.waiting.updateValue((day,), (bool(flag) or bool(held),))
        yield from self._pass(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._pass(key, timerValues.getCurrentWatermarkInMs())

    def _pass(self, key, mark: int) -> Iterator[pd.DataFrame]:
        days = sorted(k[0] for k in self.waiting.keys())
        first, last, n = self.run.get() if self.run.exists() else (0, 0, 0)
        ended = []
        for day in (d for d in days if d < mark):
            flag = self.waiting.getValue((day,))[0]
            self.waiting.removeKey((day,))
            if flag:
                first, last, n = (first if n else day), day, n + 1
            else:
                if n >= self.least:
                    ended.append((*key, first, last, n))
                first, last, n = 0, 0, 0
        self.run.update((first, last, n))
        rest = [d for d in days if d >= mark]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.handle.registerTimer(rest[0] + 1)
        if ended:
            yield pd.DataFrame(ended, columns=["station", "first", "last", "days"])

    def close(self) -> None:
        pass


def runs_on_stream(days: DataFrame, least: int, late: str = "10 days") -> DataFrame:
    """(station, start, end, days) of runs of flagged days; ``days``: station, date, flag, a stream.

    A run is told once the watermark, ``late`` behind the latest day, has passed the day that ends it; days that come
    later than that are dropped. Of a day that comes twice the flag counts if one of them has it. The session's state
    store must be RocksDB, as Spark asks for such state.
    """
    ship(days.sparkSession)
    rows = days.select(F.col("station").cast("long").alias("station"), F.col("date").cast("timestamp").alias("ts"), F.coalesce("flag", F.lit(False)).alias("flag")).withWatermark("ts", late)
    told = rows.groupBy("station").transformWithStateInPandas(OpenRuns(least), "station long, first long, last long, days long", "Append", "EventTime")
    day = lambda c: F.to_date(F.timestamp_millis(c))
    return told.select("station", day("first").alias("start"), day("last").alias("end"), "days")

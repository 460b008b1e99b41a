"""Daily weather of stations, fetched year by year, as a batch source and as a stream whose checkpoint is the cache."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


@dataclass
class StationYear(InputPartition):
    station: int
    first: dt.date
    last: dt.date


class DailyWeather(DataSource):
    """Rows (station, date, param, value), a partition for each station and year.

    Options: ``fetch`` ("module:function" that takes url, station, first and last day and the parameters, and gives
    (date, parameter, value) rows), ``url``, ``stations`` and ``params`` (comma-separated), ``start`` and ``end``
    (days), ``tries``. A stream's offset is the last day that it has told: what a checkpoint has is never fetched again,
    and a later ``end`` brings the days since, from the day after on.
    """

    @classmethod
    def name(cls) -> str:
        return "daily_weather"

    def schema(self) -> str:
        return "station long, date date, param string, value double"

    def reader(self, schema) -> WeatherReader:
        return WeatherReader(dict(self.options))

    def streamReader(self, schema) -> WeatherStream:
        return WeatherStream(dict(self.options))


class _Years:
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.tries = options, int(options.get("tries", 3))
        self.stations = [int(s) for s in options["stations"].split(",") if s.strip()]
        self.start, self.end = dt.date.fromisoformat(options["start"]), dt.date.fromisoformat(options["end"])

    def years(self, first: dt.date, last: dt.date) -> Sequence[StationYear]:
        spans = [(max(first, dt.date(y, 1, 1)), min(last, dt.date(y, 12, 31))) for y in range(first.year, last.year + 1)]
        return [StationYear(s, a, b) for s in self.stations for a, b in spans if a <= b]

    def read(self, partition: StationYear | None) -> Iterator[tuple]:
        if partition is None or partition.first > partition.last:
            return
        module, _, function = self.options["fetch"].partition(":")
        fetch, params = getattr(import_module(module), function), self.options.get("params", "rrday,tday,tmin,snow").split(",")
        for attempt in range(1, self.tries + 1):
            try:
                found = fetch(self.options.get("url", ""), partition.station, partition.first, partition.last, params)
                break
            except OSError:
                if attempt == self.tries:
                    raise
                time.sleep(2 * attempt)
        for date, param, value in found:
            day = dt.date.fromisoformat(date) if isinstance(date, str) else date
            if partition.first <= day <= partition.last and param in params:
                yield partition.station, day, param, None if value is None or value != value else float(value)


class WeatherReader(_Years, DataSourceReader):
    def partitions(self) -> Sequence[StationYear]:
        return self.years(self.start, self.end) or [StationYear(0, dt.date.max, dt.date.min)]


class WeatherStream(_Years, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"told": (self.start - dt.timedelta(days=1)).isoformat()}

    def latestOffset(self) -> dict:
        return {"told": max(self.end, self.start - dt.timedelta(days=1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> Sequence[StationYear]:
        first = dt.date.fromisoformat(start["told"]) + dt.timedelta(days=1)
        return self.years(first, dt.date.fromisoformat(end["told"])) or [StationYear(0, dt.date.max, dt.date.min)]

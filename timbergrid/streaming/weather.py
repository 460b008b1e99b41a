"""Weather readings as a stream: daily values with a watermark for late readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_values(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """(station, date, n, mean_value, least, most) of readings (station, ts, value), batch or stream.

    On a stream a day is told once the watermark has passed its end; later readings of it are dropped.
    """
    days = readings.withWatermark("ts", late).groupBy("station", F.window("ts", "1 day").alias("day"))
    told = days.agg(F.count("value").alias("n"), F.avg("value").alias("mean_value"), F.min("value").alias("least"), F.max("value").alias("most"))
    return told.select("station", F.to_date("day.start").alias("date"), "n", "mean_value", "least", "most")

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from timbergrid.operators import weather
from timbergrid.streaming.runs import runs_on_stream


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_runs_of_shuffled_days_equal_those_of_the_record(rocks, tmp_path):
    spark, rng = rocks, random.Random(4)
    first = dt.date(2021, 1, 1)
    record = [(s, first + dt.timedelta(days=k), rng.random() < 0.7) for s in (1, 2, 3) for k in range(60) if s != 3 or k % 9]
    # Days come in four files, each up to eight days out of order; a day of each station far ahead moves the watermark on.
    dealt = sorted(record, key=lambda r: (r[1] - first).days + rng.uniform(0, 8))
    parts = [dealt[k * 45 : (k + 1) * 45] for k in range(3)] + [dealt[135:]]
    parts += [[(9, first + dt.timedelta(days=200), False)], [(9, first + dt.timedelta(days=300), False)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "station long, date date, flag boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("station long, date date, flag boolean").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        writer = runs_on_stream(stream, 3).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out")
        writer.trigger(availableNow=True).start().awaitTermination(120)
    daily = spark.createDataFrame(record, "station long, date date, flag boolean")
    whole = {tuple(r) for r in weather.runs_at_least(daily, F.col("flag"), 3).select("station", "start", "end", "days").collect()}
    last = {s: max(d for x, d, f in record if x == s and not f) for s in (1, 2, 3)}
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    # A run that no day has ended yet isn't told.
    assert sorted(got) == sorted(r for r in whole if r[2] < last[r[0]]) and len(got) > 10

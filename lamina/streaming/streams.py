"""Streams: the sample stream as a source, the trailing meter as a stateful operator, windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.functions import rng


class DrawRange(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class DrawReader(DataSourceStreamReader):
    """Offsets are draw ids, so a restart goes on where the checkpoint stands, without replay."""

    def __init__(self, options: dict) -> None:
        self.seed, self.stream = int(options.get("seed", 7)), int(options.get("stream", 0))
        self.size, self.rate = int(options["size"]), int(options.get("rate", 1000))
        self.first, self.total = int(options.get("start", 0)), int(options.get("total", -1))
        self.parts = int(options.get("partitions", 4))
        self.at = self.first

    def initialOffset(self) -> dict:
        return {"draw": self.first}

    def latestOffset(self) -> dict:
        self.at += self.rate
        if self.total >= 0:
            self.at = min(self.at, self.first + self.total)
        return {"draw": self.at}

    def partitions(self, start: dict, end: dict) -> list[DrawRange]:
        self.at = max(self.at, end["draw"])
        cuts = np.linspace(start["draw"], end["draw"], self.parts + 1).astype(int)
        return [DrawRange(int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def read(self, partition: DrawRange) -> Iterator[tuple]:
        draw = np.arange(partition.start, partition.end)
        index = rng.indices(rng.values(self.seed, draw, self.stream), np.full(len(draw), self.size))
        yield from zip(draw.tolist(), index.tolist(), strict=True)


class DrawSource(DataSource):
    """format("lamina_draws"): draw, entry; options seed, stream, size, start, rate, total."""

    @classmethod
    def name(cls) -> str:
        return "lamina_draws"

    def schema(self) -> str:
        return "draw bigint, entry bigint"

    def streamReader(self, schema) -> DrawReader:
        return DrawReader(self.options)


def draws(spark: SparkSession, size: int, **options) -> DataFrame:
    spark.dataSource.register(DrawSource)
    reader = spark.readStream.format("lamina_draws").option("size", size)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


METER = "key string, n long, median double, mean double, maximum double, global_mean double"


def meter(events: DataFrame, key: str, time: str, value: str, size: int = 20) -> DataFrame:
    """State of each key's meter after every batch: count, and statistics of the last `size` values in event order. State is bounded by size."""

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, [])
        part = pd.concat(list(batches)).sort_values(["t", "v"])
        values = part["v"].to_numpy(float)
        last = ([*last, *values.tolist()])[-size:]
        n, total = n + len(values), total + float(values.sum())
        state.update((n, total, last))
        yield pd.DataFrame({"key": [name[0]], "n": [n], "median": [sorted(last)[(len(last) - 1) // 2]], "mean": [float(np.mean(last))], "maximum": [max(last)], "global_mean": [total / n]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time).alias("t"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(update, METER, "n long, total double, last array<double>", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Tumbling counts and sums with a watermark."""
    w = F.window(time, length)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a bounded stream has, as a table in memory: for tests and small results only."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)

"""Hourly folds, daily rollups, sliding films and sustained heat over streams.

Each takes a streaming DataFrame and returns one; a batch DataFrame gives the rows that the stream has given once its
watermark has passed the last event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.functions import grid


def hourly_fold(events: DataFrame, key: Column, value: str, late: str = "2 hours", time: str = "ts") -> DataFrame:
    """(t, key, value, n): mean and count for each hour and key; later events than `late` are dropped by the watermark."""
    marked = events.withWatermark(time, late).withColumn("key", key)
    return marked.groupBy(F.window(time, "1 hour"), "key").agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("t"), "key", "value", "n")


def daily_rollup(events: DataFrame, key: Column, value: str, late: str = "2 hours", time: str = "ts") -> DataFrame:
    marked = events.withWatermark(time, late).withColumn("key", key)
    return marked.groupBy(F.window(time, "1 day"), "key").agg(F.avg(value).alias("mean"), F.max(value).alias("most")).select(F.col("window.start").alias("day"), "key", "mean", "most")


def sliding_film(events: DataFrame, key: Column, value: str, days: int, late: str = "2 hours", time: str = "ts") -> DataFrame:
    """(start, key, mean): films of so many days, one begins each day."""
    marked = events.withWatermark(time, late).withColumn("key", key)
    return marked.groupBy(F.window(time, f"{days} days", "1 day"), "key").agg(F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "key", "mean")


def hot_sessions(events: DataFrame, key: Column, hot: Column, gap: str, late: str = "2 hours", time: str = "ts") -> DataFrame:
    """(key, first, last, n): runs of hot events, merged over gaps shorter than `gap`."""
    marked = events.where(hot).withWatermark(time, late).withColumn("key", key)
    return marked.groupBy(F.session_window(time, gap), "key").agg(F.count(F.lit(1)).alias("n")).select("key", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")


def with_cell_key(level: int, lat: str = "lat", lon: str = "lon") -> Column:
    return grid.cell(F.col(lat), F.col(lon), level)


class Sustained(StatefulProcessor):
    """Load of each key hour by hour; hours wait until the watermark has passed them, then run in order.

    State of a key: the last hour and load, and the hours that wait. Spark drops hours that come behind the watermark before
    they get here; one that comes in the batch of its own turn, if it does, gives a row with `late` true and changes nothing.
    """

    half_life, threshold, flush = 24.0, 27.0, 0.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t timestamp, load double")
        self.waiting = handle.getMapState("waiting", "t timestamp", "hi double, mm double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        late = []
        for frame in rows:
            for r in frame.sort_values("t").itertuples(index=False):
                if done is not None and r.t <= done:
                    late.append((key[0], r.t, None, True))
                else:
                    self.waiting.updateValue((r.t,), (float(r.hi), float(r.mm)))
                    self.handle.registerTimer(int(r.t.value // 1_000_000))
        yield pd.DataFrame(late, columns=["key", "t", "load", "late"]).astype({"t": "datetime64[ns]", "load": "float64", "late": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        out = []
        if self.waiting.containsKey((t,)):
            hi, mm = self.waiting.getValue((t,))
            a = 2 ** (-1 / self.half_life)
            if self.last.exists():
                load = (a * self.last.get()[1] + (1 - a) * max(0.0, hi - self.threshold)) * (1 - self.flush * min(1.0, mm / 2.5))
            else:
                load = 0.0
            self.last.update((t, load))
            self.waiting.removeKey((t,))
            out.append((key[0], t, load, False))
        yield pd.DataFrame(out, columns=["key", "t", "load", "late"]).astype({"t": "datetime64[ns]", "load": "float64", "late": "bool"})

    def close(self) -> None:
        pass


def sustained_stream(hours: DataFrame, half_life: float, threshold: float, flush: float = 0.0, late: str = "2 hours") -> DataFrame:
    """(key, t, load, late) of a stream of hours (key, t, hi, mm), one for each key and hour."""
    processor = type("Sustained", (Sustained,), {"half_life": half_life, "threshold": threshold, "flush": flush})()
    keyed = hours.withWatermark("t", late).groupBy("key")
    return keyed.transformWithStateInPandas(processor, "key bigint, t timestamp, load double, late boolean", "Append", "EventTime")

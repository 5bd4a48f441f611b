"""Monitors as keyed state: one sample at a time, against fixed limits.

The stream carries the limits of its monitor in each row (a stream-static join
puts them there). The state of a monitor is small and bounded: the two sums of
a CUSUM, or the latest points that the criteria look at. Each step is the same
function that the batch twin folds, so both give the same signals.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Latest points that the criteria of a monitor look at.
CONTEXT = 100
# The process that sets up a stateful query gets no shipped files: what this module defines goes to it whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cusum_step(state: tuple[float, float], z: float, k: float, h: float) -> tuple[float, float, str | None]:
    high, low = max(0.0, state[0] + z - k), min(0.0, state[1] + z + k)
    return high, low, "shift_up" if high > h else "shift_down" if -low > h else None


def completed(history: list[float], center: float, lcl: float, ucl: float, run_length: int = 7, trend_length: int = 7) -> list[str]:
    """Criteria that the last point of the history completes."""
    x, found = history[-1], []
    if x > ucl or x < lcl:
        found.append("beyond_limits")
    sides = [(v > center) - (v < center) for v in history[-run_length:]]
    if len(sides) == run_length and abs(sum(sides)) == run_length:
        found.append("run")
    last = history[-trend_length:]
    steps = [(b > a) - (b < a) for a, b in zip(last, last[1:], strict=False)]
    if len(last) == trend_length and abs(sum(steps)) == trend_length - 1:
        found.append("trend")
    return found


class CusumMonitor(StatefulProcessor):
    """Two sums per monitor, back at zero after a signal."""

    def __init__(self, k: float = 0.5, h: float = 4.774897046326059):
        self.k, self.h = k, h

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "high double, low double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values("pos")  # a monitor's samples of one micro-batch
        state = self.sums.get() if self.sums.exists() else (0.0, 0.0)
        out = []
        for pos, z in zip(batch["pos"].tolist(), ((batch["value"] - batch["mu"]) / batch["sigma"]).tolist(), strict=True):
            high, low, signal = cusum_step(state, z, self.k, self.h)
            state = (0.0, 0.0) if signal else (high, low)
            out.append((key[0], pos, high, low, signal))
        self.sums.update(state)
        yield pd.DataFrame(out, columns=["series", "pos", "high", "low", "signal"])

    def close(self) -> None:
        pass


class LimitsMonitor(StatefulProcessor):
    """The latest points of a monitor's present limits; a new revision starts with none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getValueState("points", "revision long, points array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values("pos")
        revision, points = self.points.get() if self.points.exists() else (None, [])
        points, out = list(points), []
        for pos, value, now, center, lcl, ucl in zip(*(batch[c].tolist() for c in ("pos", "value", "revision", "center", "lcl", "ucl")), strict=True):
            if now != revision:
                revision, points = now, []
            points = [*points, value][-CONTEXT:]
            out += [(key[0], pos, rule) for rule in completed(points, center, lcl, ucl)]
        self.points.update((int(revision), [float(p) for p in points]))
        yield pd.DataFrame(out, columns=["series", "pos", "rule"])

    def close(self) -> None:
        pass


def cusum_stream(samples: DataFrame, k: float = 0.5, h: float = 4.774897046326059) -> DataFrame:
    """samples: a stream of (series, pos, value, mu, sigma)."""
    return samples.groupBy("series").transformWithStateInPandas(CusumMonitor(k, h), "series string, pos long, high double, low double, signal string", "Append", "None")


def limits_stream(samples: DataFrame) -> DataFrame:
    """samples: a stream of (series, pos, value, revision, center, lcl, ucl). A row per criterion that a sample completes."""
    return samples.groupBy("series").transformWithStateInPandas(LimitsMonitor(), "series string, pos long, rule string", "Append", "None")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there, and read what it wrote. folder: shared by driver and executors."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def in_slices(df: DataFrame, order: str, slices: int, monitor: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What `monitor`, a stream of samples to a stream of rows, gives for `df` arriving in slices of rising `order`.

    Each slice is a micro-batch of its own; the query ends after it and starts
    again from its checkpoint, so state crosses batches and restarts. A monitor's
    samples of one batch are held in memory at once: slices bound them.
    """
    spark = df.sparkSession
    low, high = df.agg(F.min(order), F.max(order)).first()
    result = None
    for k in range(slices):
        first, last = (low + (high + 1 - low) * i // slices for i in (k, k + 1)) if low is not None else (0, 0)
        df.filter((F.col(order) >= first) & (F.col(order) < last)).write.mode("append").parquet(f"{folder}/samples")
        result = drained(monitor(spark.readStream.schema(df.schema).parquet(f"{folder}/samples")), folder)
    return result

"""State per key with timers: stretches of heartbeats that end after silence, and a register of each key's last value."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What keeps state with timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STRETCH = "began long, ended long, n long"


class Stretches(StatefulProcessor):
    """Holds a key's open stretch of beats, in microseconds, and a timer at its end; beats later than that begin another."""

    def __init__(self, silence: float):
        self.silence = int(silence * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STRETCH)

    def _rows(self, key: tuple, stretches: list[tuple[int, int, int]]) -> Iterator[pd.DataFrame]:
        if stretches:
            yield pd.DataFrame([(key[0], *s) for s in stretches], columns=["key", "began", "ended", "n"])

    def _timer(self, ended: int) -> int:
        # a timer goes off when the watermark has passed it; a beat at the very end still belongs
        return (ended + self.silence) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        beats = sorted(t for batch in rows for t in batch["at"])
        held = self.open.get() if self.open.exists() else None
        stretches = [tuple(held)] if held else []
        for t in beats:
            began, ended, n = stretches[-1] if stretches else (t, t, 0)
            if n and began - self.silence <= t <= ended + self.silence:
                stretches[-1] = (min(began, t), max(ended, t), n + 1)
            else:
                stretches.append((t, t, 1))
        stretches.sort()
        if held:
            self.handle.deleteTimer(self._timer(held[1]))
        self.open.update(stretches[-1])
        self.handle.registerTimer(self._timer(stretches[-1][1]))
        yield from self._rows(key, stretches[:-1])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.open.get() if self.open.exists() else None
        self.open.clear()
        yield from self._rows(key, [tuple(held)] if held else [])

    def close(self) -> None:
        pass


def stretches(beats: DataFrame, key: str, time: str, silence: float = 30, late: str = "10 seconds") -> DataFrame:
    """(key, began, ended, n) of a stream of heartbeats: one row when a stretch has ended, `silence` seconds after its last beat.

    Beats may be late by `late`, within which they may come in any order; later ones are dropped by the watermark.  Beats
    without a time or key don't count.  The session's state store must be `PROVIDER`.
    """
    kind = beats.schema[key].dataType.simpleString()
    marked = beats.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, late).select(F.col(key).alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("at"))
    out = marked.groupBy("key").transformWithStateInPandas(Stretches(silence), f"key {kind}, {_STRETCH}", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("began").alias("began"), F.timestamp_micros("ended").alias("ended"), "n")


class Register(StatefulProcessor):
    """Holds the value of each key's greatest version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version long, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = [(int(v), x) for batch in rows for v, x in zip(batch["version"], batch["value"])]
        held = tuple(self.last.get()) if self.last.exists() else None
        best = max([*seen, *([held] if held else [])], key=lambda r: (r[0], r[1] or ""))
        if best != held:
            self.last.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["key", "version", "value"])

    def close(self) -> None:
        pass


def last_values(rows: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """(key, version, value) whenever a key's value of the greatest version changes; ties of a version by value.

    Rows without a key or version don't count; an older version that comes late changes nothing.  Versions are whole numbers.
    """
    kind = rows.schema[key].dataType.simpleString()
    named = rows.where(F.col(key).isNotNull() & F.col(version).isNotNull()).select(F.col(key).alias("key"), F.col(version).cast("long").alias("version"), F.col(value).cast("string").alias("value"))
    out = named.groupBy("key").transformWithStateInPandas(Register(), f"key {kind}, version long, value string", "Update", "None")
    return out.select(F.col("key").alias(key), F.col("version").alias(version), F.col("value").alias(value))

"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def perception(events: DataFrame) -> DataFrame:
    """Running counts by type, for complete-mode output on a processing-time trigger."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.count_if(F.col("event_type") == "error").alias("errors"))


def windowed(events: DataFrame, width: str, late: str) -> DataFrame:
    """Event-time windows by type with a watermark (an extension)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once_each(events: DataFrame, late: str) -> DataFrame:
    """Each event id once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


class _Keyed(StatefulProcessor):
    """A processor of one list state; with ``idle_ms``, a key that hears nothing for so long is forgotten."""

    def __init__(self, state: str, idle_ms: int | None):
        self.state, self.idle_ms = state, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", self.state)

    def heard(self, timer_values) -> None:
        """Put the key's timer off."""
        if self.idle_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.items.clear()
        yield self.empty(key)

    def empty(self, key) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _batch(rows: Iterator[pd.DataFrame], order: list[str]) -> list[tuple]:
    """A key's rows of one trigger in order; the state between triggers is bounded, a trigger's rows of a key are its input."""
    return list(pd.concat(list(rows)).sort_values(order, kind="stable").itertuples(index=False))


class _Recent(_Keyed):
    def __init__(self, k: int, idle_ms: int | None):
        super().__init__("id long, ts_us long, value double", idle_ms)
        self.k = k

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.heard(timerValues)
        kept = [tuple(x) for x in self.items.get()] if self.items.exists() else []
        kept = sorted([*kept, *((int(r.id), int(r.ts_us), float(r.value)) for r in _batch(rows, ["ts_us", "id"]))], key=lambda x: (x[1], x[0]))[-self.k :]
        self.items.put(kept)
        yield pd.DataFrame({"key": [key[0]], "n": [len(kept)], "ids": [[x[0] for x in kept]], "mean_value": [sum(x[2] for x in kept) / len(kept)]})

    def empty(self, key) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "n": [0], "ids": [[]], "mean_value": [None]})


class _Profile(_Keyed):
    def __init__(self, alpha: float, idle_ms: int | None):
        super().__init__("n long, mean double, ema double, last double", idle_ms)
        self.alpha = alpha

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.heard(timerValues)
        n, mean, ema, last = next(iter(self.items.get())) if self.items.exists() else (0, 0.0, None, None)
        for r in _batch(rows, ["ts_us", "id"]):
            n, last = n + 1, float(r.value)
            mean += (last - mean) / n
            ema = last if ema is None else self.alpha * last + (1 - self.alpha) * ema
        self.items.put([(n, mean, ema, last)])
        yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": [mean], "ema": [ema], "last": [last]})

    def empty(self, key) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "n": [0], "mean": [None], "ema": [None], "last": [None]})


class _Lru(_Keyed):
    def __init__(self, capacity: int, idle_ms: int | None):
        super().__init__("name string, value double", idle_ms)
        self.capacity = capacity

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.heard(timerValues)
        held = dict(tuple(x) for x in self.items.get()) if self.items.exists() else {}  # from least to most recently touched
        hits = misses = 0
        for r in _batch(rows, ["ts_us", "id"]):
            if r.value is not None and r.value == r.value:  # a value sets, none gets
                held.pop(r.name, None)
                held[r.name] = float(r.value)
                if len(held) > self.capacity:
                    del held[next(iter(held))]
            elif r.name in held:
                held[r.name] = held.pop(r.name)
                hits += 1
            else:
                misses += 1
        self.items.put(list(held.items()))
        yield pd.DataFrame({"key": [key[0]], "n": [len(held)], "names": [list(held)], "hits": [hits], "misses": [misses]})

    def empty(self, key) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "n": [0], "names": [[]], "hits": [0], "misses": [0]})


def _run(events: DataFrame, processor: _Keyed, columns: list[str], schema: str) -> DataFrame:
    # with timers a query goes on as long as it may have to ring one, so it never is done with what is available
    mode = "None" if processor.idle_ms is None else "ProcessingTime"
    rows = events.where("key is not null").select("key", *columns)
    return rows.groupBy("key").transformWithStateInPandas(processor, schema, "Update", mode)


def recent_items(events: DataFrame, k: int = 20, idle_ms: int | None = None) -> DataFrame:
    """(key, n, ids, mean_value) of each key heard: its last ``k`` of (key, id, ts_us, value) by time, then id.

    Needs the RocksDB state store, as all keyed states here do. Rows without a key are left out.
    """
    return _run(events, _Recent(k, idle_ms), ["id", "ts_us", "value"], "key string, n long, ids array<long>, mean_value double")


def running_profile(events: DataFrame, alpha: float = 0.3, idle_ms: int | None = None) -> DataFrame:
    """(key, n, mean, ema, last) of each key heard, kept up over triggers; null values don't count."""
    return _run(events.where("value is not null"), _Profile(alpha, idle_ms), ["id", "ts_us", "value"], "key string, n long, mean double, ema double, last double")


def lru_cache(events: DataFrame, capacity: int = 1024, idle_ms: int | None = None) -> DataFrame:
    """(key, n, names, hits, misses): a cache for each key of (key, id, ts_us, name, value).

    A row with a value sets its name and one without gets it; both make it the most recently
    touched, and beyond ``capacity`` the least recently touched goes. hits and misses are the
    trigger's. Rows without a name are left out.
    """
    return _run(events.where("name is not null"), _Lru(capacity, idle_ms), ["id", "ts_us", "name", "value"], "key string, n long, names array<string>, hits long, misses long")

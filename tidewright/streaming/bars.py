"""Bars and recursive indicators over a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """ticker, start and the bar of each window of ticks (ticker, ts, price, volume); ticks later than the watermark are dropped by the engine."""
    at = F.struct("ts", "price")
    return (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "ticker")
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
        .select("ticker", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
    )


def stream_ema(bars: DataFrame, period: int) -> DataFrame:
    """ticker, start, ema of a stream of bars (ticker, start, close): a count and the running value are the state.

    Bars of one batch are taken in order of start; a bar that comes in a later batch than its successors counts when it comes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, value = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values("start", kind="stable")
        out = []
        for start, close in zip(rows["start"], rows["close"], strict=True):
            seen += 1
            value = _ema_step(seen, value, close, period)
            out.append((key[0], start, value if seen >= period else None))
        state.update((seen, value))
        yield pd.DataFrame(out, columns=["ticker", "start", "ema"])

    return bars.groupBy("ticker").applyInPandasWithState(step, "ticker string, start timestamp, ema double", "seen long, value double", "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """Holds a ticker's bars until the watermark has passed them, then folds them into the mean in order of time."""

    def __init__(self, period: int, idle_ms: int | None):
        self.period, self.idle_ms = period, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "last long, seen long, value double")
        self.tail = handle.getListState("tail", "at long, close double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = self.done.get()[0] if self.done.exists() else None
        new = [(int(t), float(x)) for part in rows for t, x in zip(part["at"], part["close"], strict=True) if last is None or t > last]
        if new:
            self.tail.appendList(new)
            self.handle.registerTimer(-(-min(new)[0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = dict(self.tail.get()) if self.tail.exists() else {}  # of bars of one time the one that came last
        ready, rest = sorted(t for t in held if t <= passed), [(t, x) for t, x in held.items() if t > passed]
        last, seen, value = self.done.get() if self.done.exists() else (0, 0, 0.0)
        out = []
        for at in ready:
            seen += 1
            value = _ema_step(seen, value, held[at], self.period)
            out.append((key[0], at, value if seen >= self.period else None))
        if ready:
            last = ready[-1]
            self.done.update((last, seen, value))
            if rest:
                self.tail.put(rest)
                self.handle.registerTimer(-(-min(rest)[0] // 1000))
            else:
                self.tail.clear()
            if self.idle_ms is not None:
                self.handle.registerTimer(-(-last // 1000) + self.idle_ms)
        if self.idle_ms is not None and not rest and seen and last + self.idle_ms * 1000 <= passed:
            self.done.clear()
        if out:
            yield pd.DataFrame(out, columns=["ticker", "at", "ema"])

    def close(self) -> None:
        pass


def _ema_step(seen: int, value: float, close: float, period: int) -> float:
    """The mean of the first period values, then the exponential one."""
    return value + close / period if seen <= period else close * 2 / (period + 1) + value * (1 - 2 / (period + 1))


def stream_ema_in_order(bars: DataFrame, period: int, late: str, idle_ms: int | None = None) -> DataFrame:
    """ticker, start, ema of a stream of bars (ticker, start, close) that come in any order within late.

    A bar's value is given once, when the watermark has passed it, and is that of the batch indicator whatever the
    order. State is a running value and the bars that the watermark has not passed, which timers take up; bars
    behind it are dropped. Repeated times count once, the bar that came last. After idle_ms of event time without
    a bar, a ticker's state ends and its series begins anew. A null start never passes and is left out. Needs the
    session's RocksDB state store, which holds more state than memory.
    """
    rows = bars.where("start is not null").withWatermark("start", late).select("ticker", "start", F.unix_micros("start").alias("at"), F.col("close").cast("double").alias("close"))
    found = rows.groupBy("ticker").transformWithStateInPandas(_InOrder(period, idle_ms), "ticker string, at long, ema double", "Append", "EventTime")
    return found.select("ticker", F.timestamp_micros("at").alias("start"), "ema")


def stream_new_rows(rows: DataFrame, event_time: str, late: str, *key: str) -> DataFrame:
    """Rows of a stream once each by key, within the watermark: the streaming form of an idempotent append."""
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(key))

"""Recursive indicators: row i depends on the output of row i - 1, so a ticker's series is walked in order.

A kernel takes the bar arrays of one ticker, oldest first, and its parameters, and returns its outputs with NaN
in the warm-up. All kernels of a plan run in one grouped pass; NaN becomes null on the way out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Arrays = dict[str, np.ndarray]
Job = tuple[Callable, tuple[str, ...], tuple[str, ...], dict[str, float]]
NAN = float("nan")


def ema(x: np.ndarray, period: int) -> np.ndarray:
    """Seeded with the mean of the first period values at row period - 1."""
    out = np.full(len(x), NAN)
    if len(x) >= period:
        k, value = 2 / (period + 1), float(np.sum(x[:period])) / period
        out[period - 1] = value
        for i in range(period, len(x)):
            value = float(x[i]) * k + value * (1 - k)
            out[i] = value
    return out


def wilder(x: np.ndarray, period: int, first: int) -> np.ndarray:
    """Wilder's mean, seeded with the mean of x[first : first + period]."""
    out = np.full(len(x), NAN)
    at = first + period - 1
    if len(x) > at:
        value = float(np.sum(x[first : at + 1])) / period
        out[at] = value
        for i in range(at + 1, len(x)):
            value = (value * (period - 1) + float(x[i])) / period
            out[i] = value
    return out


def _zeroed(x: np.ndarray) -> np.ndarray:
    """Warm-up rows as 0: second passes start from them, which their seeds show."""
    return np.where(np.isnan(x), 0.0, x)


def _from(x: np.ndarray, row: int) -> np.ndarray:
    return np.where(np.arange(len(x)) >= row, x, NAN)


def _divided(num: np.ndarray, den: np.ndarray, otherwise: float) -> np.ndarray:
    safe = np.where(den == 0, 1.0, den)
    return np.where(den == 0, otherwise, num / safe)


def true_range(b: Arrays) -> np.ndarray:
    out = b["high"] - b["low"]
    before = b["close"][:-1]
    out[1:] = np.maximum(out[1:], np.maximum(np.abs(b["high"][1:] - before), np.abs(b["low"][1:] - before)))
    return out


def ema_line(b: Arrays, p: dict) -> tuple:
    return (ema(b["close"], int(p["period"])),)


def dema(b: Arrays, p: dict) -> tuple:
    n = int(p["period"])
    one = ema(b["close"], n)
    return (_from(2 * one - ema(_zeroed(one), n), 2 * (n - 1)),)


def tema(b: Arrays, p: dict) -> tuple:
    n = int(p["period"])
    one = ema(b["close"], n)
    two = ema(_zeroed(one), n)
    return (_from(3 * one - 3 * two + ema(_zeroed(two), n), 3 * (n - 1)),)


def atr(b: Arrays, period: int) -> np.ndarray:
    return wilder(true_range(b), period, 0)


def atr_line(b: Arrays, p: dict) -> tuple:
    return (atr(b, int(p["period"])),)


def supertrend(b: Arrays, p: dict) -> tuple:
    n, size = int(p["period"]), len(b["close"])
    reach = p["multiplier"] * atr(b, n)
    middle, close = (b["high"] + b["low"]) / 2, b["close"]
    line, direction = np.full(size, NAN), np.full(size, NAN)
    upper = lower = way = None
    for i in range(n - 1, size):
        up, low = middle[i] + reach[i], middle[i] - reach[i]
        if i >= n:
            if close[i - 1] > lower:
                low = max(low, lower)
            if close[i - 1] < upper:
                up = min(up, upper)
            way = (-1 if close[i] < low else 1) if way == 1 else (1 if close[i] > up else -1)
            direction[i], line[i] = way, low if way == 1 else up
        upper, lower = up, low
    return direction, line


def parabolic_sar(b: Arrays, p: dict) -> tuple:
    high, low = b["high"], b["low"]
    out = np.full(len(high), NAN)
    if len(high) < 2:
        return (out,)
    rising = bool(high[1] > high[0])
    speed, extreme, stop = p["af_start"], high[0] if rising else low[0], low[0] if rising else high[0]
    out[0] = stop
    for i in range(1, len(high)):
        stop = stop + speed * (extreme - stop)
        recent = slice(max(0, i - 2), i)
        stop = min(stop, low[recent].min()) if rising else max(stop, high[recent].max())
        if (low[i] < stop) if rising else (high[i] > stop):
            rising, stop, speed = not rising, extreme, p["af_start"]
            extreme = high[i] if rising else low[i]
        elif (high[i] > extreme) if rising else (low[i] < extreme):
            extreme, speed = high[i] if rising else low[i], min(speed + p["af_increment"], p["af_max"])
        out[i] = stop
    return (out,)


def _rsi(close: np.ndarray, period: int) -> np.ndarray:
    change = np.diff(close, prepend=close[:1])
    gain, loss = wilder(np.maximum(change, 0), period, 1), wilder(np.maximum(-change, 0), period, 1)
    return np.where(np.isnan(loss), NAN, 100 - 100 / (1 + _divided(gain, loss, np.inf)))


def rsi(b: Arrays, p: dict) -> tuple:
    return (_rsi(b["close"], int(p["period"])),)


def _recent_mean(x: np.ndarray, m: int) -> np.ndarray:
    """Mean of the last m values that are there, on rows that have one."""
    out, there = np.full(len(x), NAN), np.flatnonzero(~np.isnan(x))
    for k in range(m - 1, len(there)):
        out[there[k]] = x[there[k - m + 1 : k + 1]].sum() / m
    return out


def stoch_rsi(b: Arrays, p: dict) -> tuple:
    strength = pd.Series(_rsi(b["close"], int(p["rsi_period"])))
    window = strength.rolling(int(p["stoch_period"]))
    low, span = window.min(), window.max() - window.min()
    place = np.where(np.isnan(span), NAN, _divided((strength - low).to_numpy() * 100, span.to_numpy(), 50.0))
    k = _recent_mean(place, int(p["k_smooth"]))
    return k, _recent_mean(k, int(p["d_smooth"]))


def _with_signal(line: np.ndarray, signal: int) -> tuple:
    smooth, there = ema(_zeroed(line), signal), np.flatnonzero(~np.isnan(line))
    smooth = _from(smooth, there[0] + signal - 1 if len(there) else len(line))
    smooth = np.where(np.isnan(line), NAN, smooth)
    return line, smooth, line - smooth


def macd(b: Arrays, p: dict) -> tuple:
    return _with_signal(ema(b["close"], int(p["fast"])) - ema(b["close"], int(p["slow"])), int(p["signal"]))


def ppo(b: Arrays, p: dict) -> tuple:
    slow = ema(b["close"], int(p["slow"]))
    return _with_signal(_divided((ema(b["close"], int(p["fast"])) - slow) * 100, slow, NAN), int(p["signal"]))


def adx(b: Arrays, p: dict) -> tuple:
    n, size = int(p["period"]), len(b["close"])
    up, down = np.diff(b["high"], prepend=b["high"][:1]), -np.diff(b["low"], prepend=b["low"][:1])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    # Wilder sums are Wilder means times the period
    span, rise, fall = (wilder(x, n, 1) for x in (true_range(b), plus, minus))
    plus_di, minus_di = _divided(rise * 100, span, 0.0), _divided(fall * 100, span, 0.0)
    apart = _divided(np.abs(plus_di - minus_di) * 100, plus_di + minus_di, 0.0)
    apart = np.where(np.isnan(span), NAN, apart)
    return wilder(apart, n, n) if size >= 2 * n else np.full(size, NAN), plus_di, minus_di


def tsi(b: Arrays, p: dict) -> tuple:
    long_period, short_period = int(p["long_period"]), int(p["short_period"])
    change = np.diff(b["close"], prepend=b["close"][:1])
    twice = [ema(_zeroed(ema(x, long_period)), short_period) for x in (change, np.abs(change))]
    return (_from(_divided(twice[0] * 100, twice[1], NAN), long_period + short_period - 1),)


def keltner(b: Arrays, p: dict) -> tuple:
    middle, reach = ema(b["close"], int(p["ema_period"])), p["atr_mult"] * atr(b, int(p["atr_period"]))
    return middle, middle + reach, middle - reach


def chaikin_vol(b: Arrays, p: dict) -> tuple:
    spread, back = ema(b["high"] - b["low"], int(p["ema_period"])), int(p["roc_period"])
    base = np.concatenate([np.full(min(back, len(spread)), NAN), spread[:-back]])
    return (_divided((spread - base) * 100, base, NAN),)


def heikin_ashi(b: Arrays, p: dict) -> tuple:
    close = (b["open"] + b["high"] + b["low"] + b["close"]) / 4
    opened = np.empty(len(close))
    opened[0] = (b["open"][0] + b["close"][0]) / 2
    for i in range(1, len(close)):
        opened[i] = (opened[i - 1] + close[i - 1]) / 2
    high, low = np.maximum(b["high"], np.maximum(opened, close)), np.minimum(b["low"], np.minimum(opened, close))
    high[0], low[0] = b["high"][0], b["low"][0]
    return close, opened, high, low


def run_kernels(bars: DataFrame, jobs: list[Job]) -> DataFrame:
    """bars with the outputs of all jobs (kernel, its outputs, their names here, parameters), one pass a ticker."""
    added = [name for _, _, names, _ in jobs for name in names]
    schema = T.StructType([*bars.schema.fields, *(T.StructField(n, T.DoubleType()) for n in added)])

    def walk(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("date", kind="stable").reset_index(drop=True)
        arrays = {x: own[x].to_numpy(dtype=np.float64) for x in ("open", "high", "low", "close", "volume")}
        new = {}
        for kernel, _, names, params in jobs:
            for name, values in zip(names, kernel(arrays, params), strict=True):
                new[name] = pd.Series(values).astype(object).where(~np.isnan(values), None)
        return own.assign(**new)

    return bars.groupBy("ticker").applyInPandas(walk, schema)


def rebalance_days(bars: DataFrame, days: int, on_monday: bool) -> DataFrame:
    """bars with due: whether days have passed since the last such row, or it is a Monday if those count; the first row is due."""

    def walk(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("date", kind="stable").reset_index(drop=True)
        numbers = pd.to_datetime(own["date"]).to_numpy().astype("datetime64[D]").astype(np.int64)
        due, last = np.zeros(len(own), dtype=bool), None
        for i, day in enumerate(numbers.tolist()):
            if last is None or day - last >= days or (on_monday and (day + 3) % 7 == 0):
                due[i], last = True, day
        return own.assign(due=due)

    return bars.groupBy("ticker").applyInPandas(walk, T.StructType([*bars.schema.fields, T.StructField("due", T.BooleanType())]))

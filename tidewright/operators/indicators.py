"""Technical indicators on bars as window plans; the recursive ones are in recursive.py.

Each indicator has defaults, named outputs and one primary output, the one that rules look at. Rows of the
warm-up are null. Divisions by zero have the value that each definition states.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import full, highest, lowest, mean, ordered, pop_std, prefix, prev, ratio, sample_std, total, trailing, weighted
from . import recursive, scan

Params = dict[str, float]
c = F.col


@dataclass(frozen=True)
class Indicator:
    key: str
    label: str
    category: str
    defaults: Params
    outputs: tuple[str, ...]
    make: Callable[[DataFrame, Params], DataFrame] | None = None
    kernel: Callable | None = None

    @property
    def primary(self) -> str:
        return self.outputs[0]


REGISTRY: dict[str, Indicator] = {}


def _window(key: str, label: str, category: str, outputs: tuple[str, ...] = ("value",), **defaults: float):
    def register(make):
        REGISTRY[key] = Indicator(key, label, category, defaults, outputs, make=make)
        return make

    return register


def _int(p: Params, name: str = "period") -> int:
    return int(p[name])


def _value(df: DataFrame, x) -> DataFrame:
    return df.withColumn("value", x)


@_window("sma", "SMA", "trend", period=20)
def sma(df, p):
    return _value(df, mean("close", _int(p)))


def _linear(period: int) -> list[float]:
    return [2 * (k + 1) / (period * (period + 1)) for k in range(period)]


@_window("wma", "WMA", "trend", period=20)
def wma(df, p):
    return _value(df, weighted("close", _linear(_int(p))))


@_window("hull_ma", "Hull MA", "trend", period=20)
def hull_ma(df, p):
    n = _int(p)
    half, root = max(n // 2, 1), max(int(math.sqrt(n)), 1)
    raw = df.withColumn("_raw", F.coalesce(2 * weighted("close", _linear(half)) - weighted("close", _linear(n)), F.lit(0.0)))
    smooth = raw.withColumn("_row", F.row_number().over(ordered()))
    return _value(smooth, F.when(c("_row") > n + root - 2, weighted("_raw", _linear(root)))).drop("_raw", "_row")


@_window("vwma", "VWMA", "trend", period=20)
def vwma(df, p):
    n = _int(p)
    return _value(df, full(ratio(F.sum(c("close") * c("volume")).over(trailing(n)), F.sum("volume").over(trailing(n)), c("close")), n))


def _middle(n: int):
    return (highest("high", n) + lowest("low", n)) / 2


@_window("ichimoku", "Ichimoku", "trend", ("tenkan", "kijun", "span_a", "span_b", "chikou"), conversion=9, base=26, span_b=52, displacement=26)
def ichimoku(df, p):
    shift = _int(p, "displacement")
    lines = df.withColumns({"tenkan": _middle(_int(p, "conversion")), "kijun": _middle(_int(p, "base")), "_b": _middle(_int(p, "span_b"))})
    return lines.withColumns({"span_a": prev((c("tenkan") + c("kijun")) / 2, shift), "span_b": prev("_b", shift), "chikou": F.lead("close", shift).over(ordered())}).drop("_b")


@_window("linear_regression", "Linear regression", "trend", period=20)
def linear_regression(df, p):
    n = _int(p)
    middle = (n - 1) / 2
    spread = sum((k - middle) ** 2 for k in range(n)) or 1.0
    return _value(df, weighted("close", [1 / n + (k - middle) * (n - 1 - middle) / spread for k in range(n)]))


@_window("donchian", "Donchian", "trend", ("middle", "upper", "lower"), period=20)
def donchian(df, p):
    n = _int(p)
    return df.withColumns({"upper": highest("high", n), "lower": lowest("low", n), "middle": _middle(n)})


@_window("cci", "CCI", "momentum", period=20)
def cci(df, p):
    n = _int(p)
    typical = df.withColumn("_tp", (c("high") + c("low") + c("close")) / 3)
    lists = typical.withColumns({"_mean": mean("_tp", n), "_list": F.collect_list("_tp").over(trailing(n))})
    spread = F.aggregate("_list", F.lit(0.0), lambda a, x: a + F.abs(x - c("_mean"))) / n
    return _value(lists, F.when(c("_mean").isNotNull(), ratio(c("_tp") - c("_mean"), 0.015 * spread, 0.0))).drop("_tp", "_mean", "_list")


def _rate_of_change(df, p):
    base = prev("close", _int(p))
    return _value(df, ratio((c("close") - base) * 100, base, 0.0))


_window("roc", "ROC", "momentum", period=12)(_rate_of_change)
_window("ts_momentum", "Momentum return", "momentum", period=126)(_rate_of_change)


@_window("williams_r", "Williams %R", "momentum", period=14)
def williams_r(df, p):
    top, low = highest("high", _int(p)), lowest("low", _int(p))
    return _value(df, ratio((top - c("close")) * -100, top - low, -50.0))


@_window("momentum", "Momentum", "momentum", period=10)
def momentum(df, p):
    return _value(df, c("close") - prev("close", _int(p)))


@_window("awesome_osc", "Awesome oscillator", "momentum", fast=5, slow=34)
def awesome_osc(df, p):
    middle = (c("high") + c("low")) / 2
    return _value(df, mean(middle, _int(p, "fast")) - mean(middle, _int(p, "slow")))


def _bands(p: Params):
    mid, width = mean("close", _int(p)), p["std_dev"] * pop_std("close", _int(p))
    return mid + width, mid, mid - width


@_window("bollinger", "Bollinger bands", "volatility", ("middle", "upper", "lower"), period=20, std_dev=2)
def bollinger(df, p):
    up, mid, low = _bands(p)
    return df.withColumns({"upper": up, "middle": mid, "lower": low})


@_window("bb_pct_b", "Bollinger %B", "volatility", period=20, std_dev=2)
def bb_pct_b(df, p):
    up, _, low = _bands(p)
    return _value(df, ratio(c("close") - low, up - low))


@_window("bb_width", "Bollinger width", "volatility", period=20, std_dev=2)
def bb_width(df, p):
    up, mid, low = _bands(p)
    return _value(df, ratio((up - low) * 100, mid))


@_window("hist_vol", "Historical volatility", "volatility", period=20)
def hist_vol(df, p):
    before = prev("close")
    logs = df.withColumn("_log", F.when((before > 0) & (c("close") > 0), F.ln(F.when((before > 0) & (c("close") > 0), c("close") / before))))
    return _value(logs, sample_std("_log", _int(p)) * math.sqrt(252) * 100).drop("_log")


@_window("std_dev", "Standard deviation", "volatility", period=20)
def std_dev(df, p):
    return _value(df, pop_std("close", _int(p)))


@_window("obv", "OBV", "volume")
def obv(df, p):
    before = prev("close")
    signed = df.withColumn("_flow", F.when(before.isNull(), c("volume")).otherwise(F.signum(c("close") - before) * c("volume")))
    return _value(signed, F.sum("_flow").over(prefix())).drop("_flow")


@_window("vol_sma", "Volume SMA", "volume", period=20)
def vol_sma(df, p):
    return _value(df, mean("volume", _int(p)))


def _money_flow():
    return ratio(((c("close") - c("low")) - (c("high") - c("close"))) * c("volume"), c("high") - c("low"), 0.0)


@_window("accum_dist", "Accumulation/distribution", "volume")
def accum_dist(df, p):
    return _value(df, F.sum(_money_flow()).over(prefix()))


@_window("cmf", "Chaikin money flow", "volume", period=20)
def cmf(df, p):
    n = _int(p)
    return _value(df, ratio(total(_money_flow(), n), total("volume", n), 0.0))


@_window("mfi", "Money flow index", "volume", period=14)
def mfi(df, p):
    n = _int(p)
    flows = df.withColumn("_tp", (c("high") + c("low") + c("close")) / 3).withColumns({"_before": prev("_tp"), "_row": F.row_number().over(ordered())})
    flow = c("_tp") * c("volume")
    up = F.sum(F.when(c("_tp") > c("_before"), flow).otherwise(0.0)).over(trailing(n))
    down = F.sum(F.when(c("_tp") < c("_before"), flow).otherwise(0.0)).over(trailing(n))
    index = F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.when(down != 0, down)))
    return _value(flows, F.when(c("_row") > n, index)).drop("_tp", "_before", "_row")


@_window("vwap", "VWAP", "volume")
def vwap(df, p):
    typical = (c("high") + c("low") + c("close")) / 3
    return _value(df, ratio(F.sum(typical * c("volume")).over(prefix()), F.sum("volume").over(prefix()), c("close")))


@_window("pivot_points", "Pivot points", "price", ("pp", "r1", "r2", "r3", "s1", "s2", "s3"))
def pivot_points(df, p):
    before = df.withColumns({"_h": prev("high"), "_l": prev("low"), "_c": prev("close")}).withColumn("pp", (c("_h") + c("_l") + c("_c")) / 3)
    h, low, pp = c("_h"), c("_l"), c("pp")
    return before.withColumns(
        {"r1": 2 * pp - low, "s1": 2 * pp - h, "r2": pp + (h - low), "s2": pp - (h - low), "r3": h + 2 * (pp - low), "s3": low - 2 * (h - pp)}
    ).drop("_h", "_l", "_c")


@_window("price_vs_high_low", "Price in range", "price", period=20)
def price_vs_high_low(df, p):
    top, low = highest("high", _int(p)), lowest("low", _int(p))
    return _value(df, ratio((c("close") - low) * 100, top - low, 50.0))


@_window("z_score", "Z-score", "price", period=20)
def z_score(df, p):
    return _value(df, ratio(c("close") - mean("close", _int(p)), pop_std("close", _int(p)), 0.0))


@_window("pct_from_high", "Percent from high", "price", period=52)
def pct_from_high(df, p):
    top = highest("high", _int(p))
    return _value(df, ratio((c("close") - top) * 100, top, 0.0))


@_window("support_resistance", "Support/resistance", "price", ("support", "resistance"), period=20)
def support_resistance(df, p):
    return df.withColumns({"support": lowest("low", _int(p)), "resistance": highest("high", _int(p))})


@_window("close_price", "Close", "price")
def close_price(df, p):
    return _value(df, c("close"))


def _recursive(key: str, label: str, category: str, kernel, outputs: tuple[str, ...] = ("value",), **defaults: float) -> None:
    REGISTRY[key] = Indicator(key, label, category, defaults, outputs, kernel=kernel)


_recursive("ema", "EMA", "trend", recursive.ema_line, period=20)
_recursive("dema", "DEMA", "trend", recursive.dema, period=20)
_recursive("tema", "TEMA", "trend", recursive.tema, period=20)
_recursive("supertrend", "Supertrend", "trend", recursive.supertrend, ("direction", "supertrend"), period=10, multiplier=3)
_recursive("parabolic_sar", "Parabolic SAR", "trend", recursive.parabolic_sar, af_start=0.02, af_increment=0.02, af_max=0.2)
_recursive("rsi", "RSI", "momentum", recursive.rsi, period=14)
_recursive("stoch_rsi", "Stochastic RSI", "momentum", recursive.stoch_rsi, ("k", "d"), rsi_period=14, stoch_period=14, k_smooth=3, d_smooth=3)
_recursive("macd", "MACD", "momentum", recursive.macd, ("macd", "signal", "histogram"), fast=12, slow=26, signal=9)
_recursive("adx", "ADX", "momentum", recursive.adx, ("adx", "plus_di", "minus_di"), period=14)
_recursive("tsi", "TSI", "momentum", recursive.tsi, long_period=25, short_period=13)
_recursive("ppo", "PPO", "momentum", recursive.ppo, ("ppo", "signal", "histogram"), fast=12, slow=26, signal=9)
_recursive("atr", "ATR", "volatility", recursive.atr_line, period=14)
_recursive("keltner", "Keltner channel", "volatility", recursive.keltner, ("middle", "upper", "lower"), ema_period=20, atr_period=10, atr_mult=2)
_recursive("chaikin_vol", "Chaikin volatility", "volatility", recursive.chaikin_vol, ema_period=10, roc_period=10)
_recursive("heikin_ashi", "Heikin-Ashi", "price", recursive.heikin_ashi, ("ha_close", "ha_open", "ha_high", "ha_low"))

def add_indicators(bars: DataFrame, wanted: list[tuple[str, Params]], names: list[tuple[str, ...]]) -> DataFrame:
    """bars with the outputs of each indicator under the given names; equal (type, parameters) are computed once.

    All recursive ones run in one pass over each ticker's series, all others share one window partitioning.
    """
    done: dict[tuple, tuple[str, ...]] = {}
    jobs, copies = [], {}
    for (key, params), own in zip(wanted, names, strict=True):
        spec = REGISTRY[key]
        merged = spec.defaults | params
        same = (key, *sorted(merged.items()))
        if same in done:
            copies |= {new: c(old) for new, old in zip(own, done[same], strict=True)}
            continue
        done[same] = own
        if spec.kernel:
            jobs.append((spec.kernel, spec.outputs, own, merged))
    if jobs:
        bars = recursive.run_kernels(bars, jobs)
    for same, own in done.items():
        spec = REGISTRY[same[0]]
        if spec.make:
            bars = spec.make(bars, dict(same[1:]))
            bars = bars.withColumnsRenamed(dict(zip(spec.outputs, own, strict=True)))
    return bars.withColumns(copies) if copies else bars


def indicator(bars: DataFrame, key: str, **params: float) -> DataFrame:
    """ticker, date and the outputs of one indicator. An unknown type has one output that is null throughout."""
    if key not in REGISTRY:
        return bars.select("ticker", "date", F.lit(None).cast("double").alias("value"))
    outputs = REGISTRY[key].outputs
    return add_indicators(bars, [(key, params)], [outputs]).select("ticker", "date", *outputs)


def indicator_in_blocks(bars: DataFrame, key: str, block: Column | None = None, **params: float) -> DataFrame:
    """As indicator, for the recursive types of `scan.SCANS`, with a ticker's series computed in blocks: none need fit one task."""
    return scan.indicator_in_blocks(bars, key, REGISTRY[key].defaults | params, block)

"""Affine recursions over blocks of a series, so that no ticker's bars need to fit one task.

y[i] = a[i] * y[i - 1] + b[i] composes: a block of rows is one pair (a, b). Each level of a recursion takes
three steps: reduce every block to its pair, carry the values over the blocks of a ticker (a row a block), and
finish the blocks apart, each from its carry. Rows are dealt by (ticker, block) once for all levels; blocks are
any expression that does not fall with the date, years unless another is given. The values before a block's
first row come from the last bar of the block before it.

The twelve indicators here are those whose recursion is affine; their outputs are those of
`operators.indicators`. Supertrend and the parabolic SAR branch on their own output and have no such form.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import ratio

c = F.col
KEYS = ["ticker", "_block"]
PRICES = ("open", "high", "low", "close")
Map = tuple[Column, Column]


def numbered(bars: DataFrame, block: Column | None = None) -> DataFrame:
    """bars with _block, _pos (0 for a ticker's first bar) and the prices of the bar before as _open, _high, _low, _close."""
    keyed = bars.withColumn("_block", F.year("date") if block is None else block)
    ends = keyed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_size"), F.max_by(F.struct(*PRICES), "date").alias("_last"))
    order = Window.partitionBy("ticker").orderBy("_block")  # a row a block
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*KEYS, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.lag("_last").over(order).alias("_last"))
    inside = Window.partitionBy(*KEYS).orderBy("date")
    rows = keyed.join(starts, KEYS).withColumn("_pos", F.row_number().over(inside) - 1 + c("_start"))
    return rows.withColumns({f"_{x}": F.coalesce(F.lag(x).over(inside), c(f"_last.{x}")) for x in PRICES}).drop("_start", "_last")


def _walk(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    out = np.empty(len(a))
    for i, (slope, shift) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        value = slope * value + shift
        out[i] = value
    return out


def _floats(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.float64)


def scan(rows: DataFrame, **maps: Map) -> DataFrame:
    """rows of numbered() with y[i] = a[i] * y[i - 1] + b[i] for each name and its (a, b); before the first bar y is 0."""
    names = list(maps)
    sides = {f"_{side}_{n}": maps[n][k].cast("double") for n in names for k, side in enumerate("ab")}
    mapped = rows.withColumns(sides)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    pair = [T.StructField(x, kinds[x]) for x in KEYS]
    doubles = lambda marks: [T.StructField(f"_{m}_{n}", T.DoubleType()) for n in names for m in marks]

    def reduce_block(key, table):
        table = table.sort_by("_pos")
        out = {x: [v] for x, v in zip(KEYS, key, strict=True)}
        for n in names:
            a, b = _floats(table, f"_a_{n}"), _floats(table, f"_b_{n}")
            out[f"_a_{n}"], out[f"_b_{n}"] = [float(np.prod(a))], [float(_walk(a, b, 0.0)[-1])]
        return pa.table(out)

    def carry_over(table):
        table = table.sort_by("_block")
        carried = {f"_c_{n}": np.concatenate([[0.0], _walk(_floats(table, f"_a_{n}"), _floats(table, f"_b_{n}"), 0.0)[:-1]]) for n in names}
        return pa.table({x: table.column(x) for x in KEYS} | carried)

    def finish(table):
        table = table.sort_by("_pos")
        kept = table.drop_columns([f"_{m}_{n}" for n in names for m in "abc"])
        for n in names:
            kept = kept.append_column(n, pa.array(_walk(_floats(table, f"_a_{n}"), _floats(table, f"_b_{n}"), table.column(f"_c_{n}")[0].as_py())))
        return kept

    pairs = mapped.select(*KEYS, "_pos", *sides).groupBy(*KEYS).applyInArrow(reduce_block, T.StructType(pair + doubles("ab")))
    carries = pairs.groupBy("ticker").applyInArrow(carry_over, T.StructType(pair + doubles("c")))
    done = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return mapped.join(carries, KEYS).groupBy(*KEYS).applyInArrow(finish, done)


def _from(x: Column, row: int) -> Column:
    return F.when(c("_pos") >= row, x)


def _zeroed(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _ema(x: Column, period: int) -> Map:
    """The mean of the first period values is gathered first, then decays."""
    k = 2 / (period + 1)
    late = c("_pos") >= period
    return F.when(late, 1 - k).otherwise(1.0), F.when(late, x * k).otherwise(x / period)


def _wilder(x: Column, period: int, first: int) -> Map:
    a = F.when(c("_pos") < first, 0.0).when(c("_pos") < first + period, 1.0).otherwise((period - 1) / period)
    return a, F.when(c("_pos") < first, 0.0).otherwise(x / period)


def _change(x: str) -> Column:
    return _zeroed(c(x) - c(f"_{x}"))


def _true_range() -> Column:
    return F.greatest(c("high") - c("low"), F.abs(c("high") - c("_close")), F.abs(c("low") - c("_close")))


def _emas(rows: DataFrame, p: dict, times: int) -> tuple[DataFrame, list[Column], int]:
    """The close smoothed so many times over, each from the zero-filled one before; their columns and the warm-up of one."""
    n, x, out = int(p["period"]), c("close"), []
    for k in range(times):
        name = f"_e{k}"
        rows = scan(rows, **{name: _ema(x, n)})
        x = _zeroed(_from(c(name), n - 1)) if k == 0 else c(name)
        out.append(c(name))
    return rows, out, n - 1


def ema(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    rows, (one,), warm = _emas(rows, p, 1)
    return rows, {"value": _from(one, warm)}


def dema(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    rows, (one, two), warm = _emas(rows, p, 2)
    return rows, {"value": _from(2 * one - two, 2 * warm)}


def tema(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    n = int(p["period"])
    rows, (one, two), warm = _emas(rows, p, 2)
    rows = scan(rows, _e2=_ema(_zeroed(_from(two, warm)), n))
    return rows, {"value": _from(3 * one - 3 * two + c("_e2"), 3 * warm)}


def rsi(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    n, move = int(p["period"]), _change("close")
    rows = scan(rows, _gain=_wilder(F.greatest(move, F.lit(0.0)), n, 1), _loss=_wilder(F.greatest(-move, F.lit(0.0)), n, 1))
    strength = F.when(c("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(c("_gain"), c("_loss"))))
    return rows, {"value": _from(strength, n)}


def _with_signal(rows: DataFrame, line: Column, name: str, warm: int, signal: int) -> tuple[DataFrame, dict[str, Column]]:
    """A line, its smoothed self from signal - 1 rows after its first value, and their difference."""
    rows = rows.withColumn(f"_{name}", line)
    firsts = rows.where(c("_pos") >= warm).groupBy("ticker").agg(F.min(F.when(c(f"_{name}").isNotNull(), c("_pos"))).alias("_there"))
    rows = scan(rows, _smooth=_ema(_zeroed(c(f"_{name}")), signal)).join(firsts, "ticker", "left")
    smooth = F.when(c(f"_{name}").isNotNull() & (c("_pos") >= c("_there") + signal - 1), c("_smooth"))
    return rows, {name: c(f"_{name}"), "signal": smooth, "histogram": c(f"_{name}") - smooth}


def _fast_slow(rows: DataFrame, p: dict) -> tuple[DataFrame, int]:
    fast, slow = int(p["fast"]), int(p["slow"])
    return scan(rows, _fast=_ema(c("close"), fast), _slow=_ema(c("close"), slow)), max(fast, slow) - 1


def macd(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    rows, warm = _fast_slow(rows, p)
    return _with_signal(rows, _from(c("_fast") - c("_slow"), warm), "macd", warm, int(p["signal"]))


def ppo(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    rows, warm = _fast_slow(rows, p)
    return _with_signal(rows, _from(ratio((c("_fast") - c("_slow")) * 100, c("_slow")), warm), "ppo", warm, int(p["signal"]))


def atr(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    n = int(p["period"])
    return scan(rows, _atr=_wilder(_true_range(), n, 0)), {"value": _from(c("_atr"), n - 1)}


def adx(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    n, up, down = int(p["period"]), _change("high"), -_change("low")
    plus, minus = (F.when((x > y) & (x > 0), x).otherwise(0.0) for x, y in ((up, down), (down, up)))
    rows = scan(rows, _span=_wilder(_true_range(), n, 1), _rise=_wilder(plus, n, 1), _fall=_wilder(minus, n, 1))
    plus_di, minus_di = (_from(ratio(c(x) * 100, c("_span"), 0.0), n) for x in ("_rise", "_fall"))
    rows = rows.withColumns({"_plus": plus_di, "_minus": minus_di})
    apart = ratio(F.abs(c("_plus") - c("_minus")) * 100, c("_plus") + c("_minus"), 0.0)
    rows = scan(rows, _adx=_wilder(_zeroed(apart), n, n))
    return rows, {"adx": _from(c("_adx"), 2 * n - 1), "plus_di": c("_plus"), "minus_di": c("_minus")}


def tsi(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    slow, fast, move = int(p["long_period"]), int(p["short_period"]), _change("close")
    rows = scan(rows, _m=_ema(move, slow), _n=_ema(F.abs(move), slow))
    rows = scan(rows, _mm=_ema(_zeroed(_from(c("_m"), slow - 1)), fast), _nn=_ema(_zeroed(_from(c("_n"), slow - 1)), fast))
    return rows, {"value": _from(ratio(c("_mm") * 100, c("_nn")), slow + fast - 1)}


def keltner(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    n, m = int(p["ema_period"]), int(p["atr_period"])
    rows = scan(rows, _middle=_ema(c("close"), n), _atr=_wilder(_true_range(), m, 0))
    middle, reach = _from(c("_middle"), n - 1), p["atr_mult"] * _from(c("_atr"), m - 1)
    return rows, {"middle": middle, "upper": middle + reach, "lower": middle - reach}


def chaikin_vol(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    n, back = int(p["ema_period"]), int(p["roc_period"])
    rows = scan(rows, _spread=_ema(c("high") - c("low"), n))
    earlier = rows.select("ticker", (c("_pos") + back).alias("_pos"), _from(c("_spread"), n - 1).alias("_base"))
    rows = rows.join(earlier, ["ticker", "_pos"], "left")
    return rows, {"value": ratio((c("_spread") - c("_base")) * 100, c("_base"))}


def heikin_ashi(rows: DataFrame, p: dict) -> tuple[DataFrame, dict[str, Column]]:
    first = c("_pos") == 0
    mean = lambda mark: (c(f"{mark}open") + c(f"{mark}high") + c(f"{mark}low") + c(f"{mark}close")) / 4
    rows = scan(rows, _opened=(F.when(first, 0.0).otherwise(0.5), F.when(first, (c("open") + c("close")) / 2).otherwise(mean("_") / 2)))
    high, low = F.greatest(c("high"), c("_opened"), mean("")), F.least(c("low"), c("_opened"), mean(""))
    return rows, {"ha_close": mean(""), "ha_open": c("_opened"), "ha_high": F.when(first, c("high")).otherwise(high), "ha_low": F.when(first, c("low")).otherwise(low)}


SCANS: dict[str, Callable[[DataFrame, dict], tuple[DataFrame, dict[str, Column]]]] = {
    f.__name__: f for f in (ema, dema, tema, rsi, macd, ppo, atr, adx, tsi, keltner, chaikin_vol, heikin_ashi)
}


def indicator_in_blocks(bars: DataFrame, key: str, params: dict[str, float], block: Column | None = None) -> DataFrame:
    """ticker, date and the outputs of one affine indicator; params: all of its parameters."""
    rows, outputs = SCANS[key](numbered(bars, block), params)
    return rows.select("ticker", "date", *[x.alias(n) for n, x in outputs.items()])

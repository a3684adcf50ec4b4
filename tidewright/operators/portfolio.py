"""Portfolio matrices, risk measures, drawdown episodes and periodic investing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import ordered, prefix, prev, ratio
from .factors import returns_by_date

c = F.col
YEAR, RF = 252, 0.06


def by_date(by: Sequence[str] = ()):
    """Dates in order, of each portfolio if by names the columns that tell them apart; a single one's series has a row a date, few at any scale."""
    return Window.partitionBy(*by).orderBy("date") if by else Window.orderBy("date")


def to_date(by: Sequence[str] = ()):
    return by_date(by).rowsBetween(Window.unboundedPreceding, 0)


def last_dates(period: int, by: Sequence[str] = ()):
    return by_date(by).rowsBetween(-(period - 1), 0)


# Matrices in long form: i, j and a value.


def align_tail(bars: DataFrame) -> DataFrame:
    """ticker, t, ret: the last min(length) returns of each ticker by position from the end (t = 1 newest), null as 0."""
    return align_returns(returns_by_date(bars))


def align_returns(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, ticker, t, ret) of ticker, date, ret: the last min(length) returns of each ticker of a portfolio, null as 0."""
    rows = returns.withColumn("t", F.row_number().over(Window.partitionBy(*by, "ticker").orderBy(F.desc("date"))))
    lengths = rows.groupBy(*by, "ticker").agg(F.max("t").alias("_n"))
    shortest = lengths.groupBy(*by).agg(F.min("_n").alias("_n"))
    joined = rows.join(shortest, list(by)) if by else rows.join(F.broadcast(shortest))  # one row
    return joined.where(c("t") <= c("_n")).select(*by, "ticker", "t", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def pair_table(aligned: DataFrame, *aggregates: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, j) with aggregates over x and y, the returns of i and j at one position t; the upper half is computed and mirrored.

    The members at one position (K of them) meet in one row, and their pairs are made from it, so the returns are read once.
    """
    at_t = aligned.groupBy(*by, "t").agg(F.sort_array(F.collect_list(F.struct("ticker", "ret"))).alias("own"))

    def with_later(a: Column, k: Column) -> Column:
        return F.transform(F.slice("own", k + 1, F.size("own")), lambda b: F.struct(a["ticker"].alias("i"), b["ticker"].alias("j"), a["ret"].alias("x"), b["ret"].alias("y")))

    pairs = at_t.select(*by, F.explode(F.flatten(F.transform("own", with_later))).alias("p")).select(*by, "p.*")
    half = pairs.groupBy(*by, "i", "j").agg(*aggregates)
    rest = [x for x in half.columns if x not in (*by, "i", "j")]
    one = lambda i, j: F.struct(c(i).alias("i"), c(j).alias("j"))
    sides = F.when(c("i") == c("j"), F.array(one("i", "j"))).otherwise(F.array(one("i", "j"), one("j", "i")))
    return half.select(*by, F.explode(sides).alias("_side"), *rest).select(*by, "_side.i", "_side.j", *rest)


def covariance(aligned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, j), cov, periods: sample covariances and the returns that they are of."""
    return pair_table(aligned, F.coalesce(F.covar_samp("x", "y"), F.lit(0.0)).alias("cov"), F.count(F.lit(1)).alias("periods"), by=by)


def tiled_covariance(aligned: DataFrame, by: Sequence[str] = (), tile: int = 256, dates: int = 1024) -> DataFrame:
    """As covariance, for thousands of members: products of tiles of members and dates instead of a row a pair and date.

    Returns less their member's mean are laid out as tiles (tile members x dates positions); every two tiles of the
    same positions meet in one task, which multiplies them, and their products are added by pair of tiles. A task
    holds two tiles, and one sum of tile x tile, whatever the members and dates.
    """
    key = list(by)
    names = aligned.groupBy(*key, "ticker").agg(F.avg("ret").alias("_mean"), F.count(F.lit(1)).alias("periods"))
    order = Window.partitionBy(*key).orderBy("ticker") if key else Window.orderBy("ticker")  # a row a member
    placed = names.withColumn("_k", F.row_number().over(order) - 1)
    rows = aligned.join(placed, [*key, "ticker"]).select(*key, F.floor(c("_k") / tile).alias("_tile"), (c("_k") % tile).alias("_at"), F.floor(c("t") / dates).alias("_part"), (c("t") % dates).alias("_t"), (c("ret") - c("_mean")).alias("_x"))
    tiles = rows.groupBy(*key, "_tile", "_part").agg(F.collect_list(F.struct("_at", "_t", "_x")).alias("_cells"))
    last = placed.groupBy(*key).agg(F.floor(F.max("_k") / tile).alias("_last"))
    tiles = tiles.join(last, key) if key else tiles.join(F.broadcast(last))  # one row
    # every tile goes to its pairs with all tiles, the smaller number first
    paired = tiles.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), c("_last")))).select(
        *key, "_part", F.least("_tile", "_other").alias("_a"), F.greatest("_tile", "_other").alias("_b"), "_tile", "_cells"
    )
    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}
    keys = "".join(f"{x} {kinds[x]}, " for x in key)

    def laid_out(cells) -> np.ndarray:
        flat = cells.combine_chunks().flatten()
        at, t, x = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        out = np.zeros((tile, dates))
        out[at, t] = x
        return out

    def multiply(group, table):
        of = {n: laid_out(table.column("_cells").slice(i, 1)) for i, n in enumerate(table.column("_tile").to_pylist())}
        *own, _, a, b = (v.as_py() for v in group)
        product = of[a] @ of[b].T if a in of and b in of else np.zeros((tile, tile))
        return pa.table({**{x: [v] for x, v in zip(key, own, strict=True)}, "_a": [a], "_b": [b], "_product": pa.array([product.tobytes()], pa.binary())})

    def add(group, table):
        *own, a, b = (v.as_py() for v in group)
        total = sum(np.frombuffer(v.as_py()) for v in table.column("_product")).reshape(tile, tile)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(tile) + a * tile, np.arange(tile) + b * tile, indexing="ij"))
        return pa.table({**{x: [v] * len(i) for x, v in zip(key, own, strict=True)}, "_i": i, "_j": j, "_sum": total.ravel()})

    parts = paired.groupBy(*key, "_part", "_a", "_b").applyInArrow(multiply, f"{keys}_a long, _b long, _product binary")
    sums = parts.groupBy(*key, "_a", "_b").applyInArrow(add, f"{keys}_i long, _j long, _sum double")
    left = placed.select(*key, c("_k").cast("long").alias("_i"), c("ticker").alias("i"), "periods")
    right = placed.select(*key, c("_k").cast("long").alias("_j"), c("ticker").alias("j"))
    half = sums.where("_i <= _j").join(left, [*key, "_i"]).join(right, [*key, "_j"])
    cov = F.when(c("periods") > 1, c("_sum") / (c("periods") - 1)).otherwise(0.0)
    one = lambda i, j: F.struct(c(i).alias("i"), c(j).alias("j"))
    sides = F.when(c("i") == c("j"), F.array(one("i", "j"))).otherwise(F.array(one("i", "j"), one("j", "i")))
    return half.select(*key, F.explode(sides).alias("_side"), cov.alias("cov"), "periods").select(*key, "_side.i", "_side.j", "cov", "periods")


def shrink(cov: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(1 - a) cov + a * mean variance on the diagonal, a = n / (n + periods) within 0.01 and 0.5. A portfolio's K x K rows are one window partition."""
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    own = c("i") == c("j")
    known = cov.withColumns({"_avg": F.avg(F.when(own, c("cov"))).over(whole), "_n": F.count_if(own).over(whole)})
    a = F.greatest(F.least(c("_n") / (c("_n") + c("periods")), F.lit(0.5)), F.lit(0.01))
    return known.withColumn("cov", (1 - a) * c("cov") + F.when(own, a * c("_avg")).otherwise(0.0)).drop("_avg", "_n")


def correlation(cov: DataFrame) -> DataFrame:
    """i, j, corr from covariances, within -1 and 1; 1 on the diagonal, 0 where a deviation is tiny."""
    own = F.max(F.when(c("i") == c("j"), c("cov")))
    joined = cov.withColumns({"vi": own.over(Window.partitionBy("i")), "vj": own.over(Window.partitionBy("j"))})
    scale = F.sqrt(c("vi") * c("vj"))
    value = F.when(c("i") == c("j"), 1.0).when(scale > 1e-15, F.greatest(F.least(c("cov") / F.when(scale > 1e-15, scale), F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
    return joined.select("i", "j", value.alias("corr"))


def correlation_matrix(aligned: DataFrame) -> DataFrame:
    """i, j, corr from returns; a constant series has 0 throughout, its diagonal too."""
    value = ratio(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"), 0.0)
    return pair_table(aligned, F.greatest(F.least(F.coalesce(value, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)).alias("corr"))


def mat_mul(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, value of two matrices i, j, value."""
    right = b.select(c("i").alias("k"), c("j").alias("j2"), c("value").alias("v2"))
    return a.withColumnRenamed("j", "k").join(right, "k").groupBy("i", c("j2").alias("j")).agg(F.sum(c("value") * c("v2")).alias("value"))


def ann_stats(aligned: DataFrame) -> DataFrame:
    """ticker, mu, sigma: mean and sample deviation of daily returns over a year; sigma 0 below two returns."""
    return aligned.groupBy("ticker").agg((F.avg("ret") * YEAR).alias("mu"), F.coalesce(F.stddev_samp("ret") * math.sqrt(YEAR), F.lit(0.0)).alias("sigma"))


def alloc_equal(stats: DataFrame) -> DataFrame:
    n = stats.agg(F.count(F.lit(1)).alias("_n"))
    return stats.join(F.broadcast(n)).select("ticker", (1 / c("_n")).alias("weight"))


def alloc_inverse_vol(stats: DataFrame) -> DataFrame:
    """Weights in proportion to 1 / sigma; sigma near 0 has none; equal where all are so."""
    inverse = stats.withColumn("_v", F.when(c("sigma") > 1e-10, 1 / F.when(c("sigma") > 1e-10, c("sigma"))).otherwise(0.0))
    total = inverse.agg(F.sum("_v").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return inverse.join(F.broadcast(total)).select("ticker", F.when(c("_sum") < 1e-15, 1 / c("_n")).otherwise(c("_v") / F.when(c("_sum") >= 1e-15, c("_sum"))).alias("weight"))


def _weighted(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """i, wi, sw: each member's weight and its entry of the covariance times the weights."""
    wi, wj = weights.select(c("ticker").alias("i"), c("weight").alias("wi")), weights.select(c("ticker").alias("j"), c("weight").alias("wj"))
    return cov.join(wi, "i").join(wj, "j").groupBy("i", "wi").agg(F.sum(c("cov") * c("wj")).alias("sw"))


def portfolio_risk(cov: DataFrame, stats: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: expected_return, volatility, sharpe and diversification_ratio of annual covariances and stats."""
    joined = _weighted(cov, weights).join(stats.withColumnRenamed("ticker", "i"), "i")
    total = joined.agg(F.sum(c("wi") * c("mu")).alias("expected_return"), F.sum(c("wi") * c("sigma")).alias("_ws"), F.greatest(F.sum(c("wi") * c("sw")), F.lit(0.0)).alias("_var"))
    vol = F.sqrt("_var")
    return total.select("expected_return", vol.alias("volatility"), F.when(vol > 1e-10, (c("expected_return") - RF) / F.when(vol > 1e-10, vol)).otherwise(0.0).alias("sharpe"), F.when(vol > 1e-15, c("_ws") / F.when(vol > 1e-15, vol)).otherwise(1.0).alias("diversification_ratio"))


def diversification_ratio(aligned: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: ratio of the weighted deviations to the portfolio's, 1 where that is 0. Weights must be of the same members and sum to 1, or the query fails."""
    given = weights.select("ticker", "weight")
    members = aligned.groupBy("ticker").agg(F.stddev_samp("ret").alias("s"), F.lit(True).alias("_own")).join(given, "ticker", "full")
    parts = members.agg(F.sum(c("weight") * c("s")).alias("_parts"), F.count_if(c("_own").isNull() | c("weight").isNull()).alias("_odd"), F.count(F.lit(1)).alias("_n"), F.sum("weight").alias("_sum"))
    fits = F.when((c("_odd") > 0) | (c("_n") == 0), F.raise_error(F.lit("the weights are not of the members"))).when(F.abs(c("_sum") - 1) > 1e-6, F.raise_error(F.concat(F.lit("the weights sum to "), c("_sum").cast("string")))).otherwise(c("_parts"))
    joint = aligned.join(given, "ticker").groupBy("t").agg(F.sum(c("weight") * c("ret")).alias("r")).agg(F.stddev_samp("r").alias("_whole"))
    return parts.select(fits.cast("double").alias("_parts")).join(joint).select(ratio(c("_parts"), c("_whole"), 1.0).alias("ratio"))


def risk_contribution(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """ticker, contribution: each member's share of the variance; the shares sum to 1."""
    own = _weighted(cov, weights)
    total = own.agg(F.sum(c("wi") * c("sw")).alias("_var"))
    return own.join(F.broadcast(total)).select(c("i").alias("ticker"), ratio(c("wi") * c("sw"), c("_var"), 0.0).alias("contribution"))


# A portfolio's series by date.


def date_intersection(bars: DataFrame, members: int) -> DataFrame:
    """bars on the dates on which every one of so many members has a bar."""
    return bars.join(bars.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") == members).select("date"), "date", "left_semi")


def portfolio_returns(bars: DataFrame, weights: DataFrame) -> DataFrame:
    """date, ret: weighted returns on aligned bars, the first date left out; a base of 0 or less returns 0."""
    rows = bars.select("ticker", "date", F.row_number().over(ordered()).alias("_n"), F.when(prev("close") > 0, c("close") / F.when(prev("close") > 0, prev("close")) - 1).otherwise(0.0).alias("r"))
    return rows.where("_n > 1").join(weights, "ticker").groupBy("date").agg(F.sum(c("weight") * c("r")).alias("ret"))


def equity(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """date, ret, equity: 100 times the running product of 1 + ret."""
    return returns.withColumn("equity", 100 * F.product(1 + c("ret")).over(to_date(by)))


def portfolio_series(bars: DataFrame, weights: DataFrame) -> DataFrame:
    """portfolio_id, date, ret, equity of any number of portfolios (weights: portfolio_id, ticker, weight), each on the dates that all of its members have."""
    sized = weights.select("portfolio_id", "ticker", "weight", F.count(F.lit(1)).over(Window.partitionBy("portfolio_id")).alias("_k"))
    held = bars.select("ticker", "date", "close").join(sized, "ticker")
    common = held.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("portfolio_id", "date"))).where(c("_n") == c("_k"))
    own = Window.partitionBy("portfolio_id", "ticker").orderBy("date")
    before = F.lag("close").over(own)
    rows = common.select("portfolio_id", "date", "weight", F.row_number().over(own).alias("_row"), F.when(before > 0, c("close") / F.when(before > 0, before) - 1).otherwise(0.0).alias("r"))
    returns = rows.where("_row > 1").groupBy("portfolio_id", "date").agg(F.sum(c("weight") * c("r")).alias("ret"))
    return equity(returns, ["portfolio_id"])


def lots_for_capital(bars: DataFrame, weights: DataFrame, dims: DataFrame, capital: float) -> DataFrame:
    """ticker, lots that the capital's share buys at the last close."""
    last = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    value = c("lot_size") * c("close")
    joined = last.join(weights, "ticker").join(dims.select("ticker", "lot_size"), "ticker")
    return joined.select("ticker", F.when(value > 0, F.floor(capital * c("weight") / F.when(value > 0, value))).otherwise(0).cast("long").alias("lots"))


def _full(x: Column, period: int, by: Sequence[str]) -> Column:
    return F.when(F.count("ret").over(last_dates(period, by)) == period, x)


def rolling_volatility(returns: DataFrame, period: int = 126, by: Sequence[str] = ()) -> DataFrame:
    return returns.select(*by, "date", _full(F.stddev_samp("ret").over(last_dates(period, by)) * math.sqrt(YEAR), period, by).alias("volatility"))


def rolling_sharpe(returns: DataFrame, period: int = 126, rf: float = RF, by: Sequence[str] = ()) -> DataFrame:
    mean, sd = F.avg("ret").over(last_dates(period, by)), F.stddev_samp("ret").over(last_dates(period, by))
    return returns.select(*by, "date", _full(ratio(mean - rf / YEAR, sd) * math.sqrt(YEAR), period, by).alias("sharpe"))


def risk_summary(curve: DataFrame, rf: float = RF, by: Sequence[str] = ()) -> DataFrame:
    """One row (each of by): ann_volatility, sharpe, sortino (against 0), max_drawdown and calmar of date, ret, equity."""
    peak = F.max("equity").over(to_date(by))
    rows = curve.withColumn("_dd", F.when(peak > 0, (peak - c("equity")) / F.when(peak > 0, peak)).otherwise(0.0))
    short = F.least(c("ret"), F.lit(0.0))
    total = rows.groupBy(*by).agg(F.avg("ret").alias("m"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("s"), F.sqrt(F.avg(short * short)).alias("d"), F.max("_dd").alias("max_drawdown"))
    root = math.sqrt(YEAR)
    return total.select(
        *by, (c("s") * root).alias("ann_volatility"), (ratio(c("m") - rf / YEAR, c("s"), 0.0) * root).alias("sharpe"), (ratio(c("m"), c("d"), 0.0) * root).alias("sortino"), "max_drawdown", ratio(c("m") * YEAR, c("max_drawdown"), 0.0).alias("calmar"),
    )


def top_drawdowns(curve: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The n deepest episodes (of each of by): peak (the latest equal high), trough (the first minimum), recovery (first date back at the peak, or null)."""
    marked = curve.withColumn("_high", (c("equity") >= F.max("equity").over(to_date(by))).cast("int")).withColumn("_g", F.sum("_high").over(to_date(by)))
    episodes = marked.groupBy(*by, "_g").agg(
        F.min("date").alias("peak_date"), F.max("equity").alias("_peak"), F.min(F.struct("equity", "date")).alias("_low"), F.count(F.lit(1)).alias("_n")
    )
    order = (Window.partitionBy(*by) if by else Window).orderBy("_g")
    ended = episodes.withColumn("recovery_date", F.lead("peak_date").over(order)).where((c("_n") > 1) & (c("_low.equity") < c("_peak")) & (c("_peak") > 0))
    depth = (c("_peak") - c("_low.equity")) / F.when(c("_peak") > 0, c("_peak"))
    found = ended.select(*by, "peak_date", c("_low.date").alias("trough_date"), "recovery_date", depth.alias("depth"))
    if not by:
        return found.orderBy(F.desc("depth"), "peak_date").limit(n)
    deepest = Window.partitionBy(*by).orderBy(F.desc("depth"), "peak_date")
    return found.withColumn("_n", F.row_number().over(deepest)).where(c("_n") <= n).drop("_n")


def histogram(values: DataFrame, column: str, buckets: int | Column) -> DataFrame:
    """bucket, low, high, n of equal widths, the last with its upper end; empty ones with 0; equal values are one bucket."""
    good = values.where(F.abs(c(column)) < float("inf")).select(c(column).alias("x"))
    ends = good.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
    asked = F.lit(buckets) if isinstance(buckets, int) else buckets
    ends = ends.withColumn("k", F.when(c("hi") > c("lo"), asked).otherwise(1).cast("int")).withColumn("w", (c("hi") - c("lo")) / c("k"))
    place = F.when(c("w") > 0, F.least(F.floor((c("x") - c("lo")) / F.when(c("w") > 0, c("w"))), c("k") - 1)).otherwise(0).cast("int")
    counted = good.join(F.broadcast(ends)).groupBy(place.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    slots = ends.select(F.explode(F.sequence(F.lit(0), c("k") - 1)).alias("bucket"), "lo", "w", "hi", "k")
    high = F.when(c("bucket") == c("k") - 1, c("hi")).otherwise(c("lo") + (c("bucket") + 1) * c("w"))
    return slots.join(counted, "bucket", "left").select("bucket", (c("lo") + c("bucket") * c("w")).alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def trade_buckets() -> Column:
    """Buckets of a trade histogram: the root of the count, between 5 and 20."""
    return F.greatest(F.least(F.floor(F.sqrt("_rows")), F.lit(20)), F.lit(5))


def trade_stats(trades: DataFrame) -> DataFrame:
    """Here a trade of 0 counts as won."""
    won = c("pnl") >= 0
    return trades.groupBy("ticker").agg(F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), F.coalesce(F.avg(F.when(won, c("pnl"))), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(~won, c("pnl"))), F.lit(0.0)).alias("avg_loss"))


# Periodic investing, by ticker.


def lump_sum(bars: DataFrame, capital: float) -> DataFrame:
    """ticker, date, value of all capital invested at the first close."""
    first = F.first("close").over(prefix())
    return bars.select("ticker", "date", (capital * ratio(c("close"), first)).alias("value"))


def dca(bars: DataFrame, capital: float, frequency: str = "weekly") -> DataFrame:
    """ticker, date, invested, value of equal contributions on every fifth row or on the first row of each month, of which the capital is the sum."""
    if frequency == "weekly":
        pays = (F.row_number().over(ordered()) - 1) % 5 == 0
    elif frequency == "monthly":
        pays = F.coalesce(F.trunc("date", "month") != F.trunc(prev("date"), "month"), F.lit(True))
    else:
        raise ValueError(f"unknown frequency: {frequency}")
    rows = bars.withColumn("_pays", pays.cast("int"))
    rows = rows.withColumn("_part", capital * c("_pays") / F.sum("_pays").over(Window.partitionBy("ticker")))
    shares = F.sum(ratio(c("_part"), c("close"), 0.0)).over(prefix())
    return rows.select("ticker", "date", F.sum("_part").over(prefix()).alias("invested"), (shares * c("close")).alias("value"))


def annualized_return(terminal: Column, invested: Column, days: Column) -> Column:
    good = (invested > 0) & (days > 0)
    return F.when(good, F.pow(terminal / F.when(invested > 0, invested), YEAR / F.when(days > 0, days)) - 1)



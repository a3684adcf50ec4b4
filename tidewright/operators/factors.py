"""Price factors, cross-sectional scores and selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import ordered, prefix, prev, ratio

c = F.col
YEAR, HALF_YEAR, SKIP, REVERSAL, MONTH = 252, 126, 21, 5, 21
WINSOR = 3.0

#: Price factors, fundamental factors, and the sign with which each counts.
PRICE_FACTORS = ("mom12_1", "mom6_1", "low_vol", "short_rev", "low_beta", "low_disp")
FUNDAMENTALS = {"trailingPE": "pe", "priceToBook": "pb", "returnOnEquity": "roe", "revenueGrowth": "rev_growth", "debtToEquity": "de"}
FACTORS = (*PRICE_FACTORS, *FUNDAMENTALS.values())
DIRECTION = dict(zip(FACTORS, (1, 1, -1, -1, -1, -1, -1, -1, 1, 1, -1), strict=True))

#: Preset weights in the order of FACTORS.
PRESETS = {
    "growth": (0.30, 0.15, 0.05, 0.0, 0.05, 0.15, 0.0, 0.0, 0.15, 0.15, 0.0),
    "balanced": (0.15, 0.10, 0.15, 0.0, 0.15, 0.10, 0.10, 0.05, 0.10, 0.05, 0.05),
    "defensive": (0.05, 0.05, 0.25, 0.05, 0.25, 0.10, 0.05, 0.05, 0.05, 0.0, 0.10),
    "contrarian": (-0.20, -0.10, 0.10, 0.30, 0.05, 0.10, 0.15, 0.05, 0.0, 0.0, 0.05),
    "value": (0.0, 0.0, 0.05, 0.0, 0.05, 0.05, 0.30, 0.20, 0.15, 0.05, 0.15),
}


def market_proxy(bars: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """date, level: the closes of an index's bars if there is one, else the equal-weight mean return of all tickers each date, cumulated from 100; the window is over dates, few at any scale."""
    if index is not None:
        return index.select("date", c("close").alias("level"))
    returns = bars.select("date", F.when(prev("close") > 0, c("close") / F.when(prev("close") > 0, prev("close")) - 1).alias("r"))
    daily = returns.groupBy("date").agg(F.avg("r").alias("r"))
    by_date = Window.orderBy("date")
    growth = F.when(F.row_number().over(by_date) == 1, 1.0).otherwise(1 + F.coalesce("r", F.lit(0.0)))
    return daily.select("date", growth.alias("g")).select("date", (100 * F.product("g").over(by_date.rowsBetween(Window.unboundedPreceding, 0))).alias("level"))


def align_market(bars: DataFrame, proxy: DataFrame) -> DataFrame:
    """bars with market: the proxy level of the last of the ticker's own dates that has one, up to each date; null before the first. Levels dated between two bars are not seen: see asof_market."""
    levels = F.broadcast(proxy.select("date", c("level").alias("market")))  # a row a date: bars stay as they are dealt out
    return bars.join(levels, "date", "left").withColumn("market", F.last("market", ignorenulls=True).over(prefix()))


def asof_market(bars: DataFrame, proxy: DataFrame) -> DataFrame:
    """bars with market: the last proxy level known on or before each date, whatever dates the proxy has; null before the first, repeated dates by the highest level.

    Both sides' dates are merged, each once, and levels carried forward: within a year by a window of its dates,
    over years by one of a row a year. Bars only join the dates.
    """
    dates = bars.select("date", F.lit(None).cast("double").alias("level")).unionByName(proxy.select("date", "level"))
    known = dates.groupBy("date").agg(F.max("level").alias("level")).withColumn("_year", F.year("date"))
    ends = known.groupBy("_year").agg(F.max_by("level", F.when(c("level").isNotNull(), c("date"))).alias("_end"))
    years = Window.orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_year", F.last("_end", ignorenulls=True).over(years).alias("_before"))
    inside = Window.partitionBy("_year").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    levels = known.withColumn("_within", F.last("level", ignorenulls=True).over(inside)).join(before, "_year")
    return bars.join(levels.select("date", F.coalesce("_within", "_before").alias("market")), "date")


def price_factors(bars: DataFrame, proxy: DataFrame) -> DataFrame:
    """One row a ticker with the six price factors, null where history is too short."""
    simple = lambda x: F.coalesce(ratio(c(x), prev(x), 1.0) - 1, F.lit(0.0))
    back = F.count(F.lit(1)).over(Window.partitionBy("ticker")) - F.row_number().over(ordered()) + 1  # from the last date, without a sort of its own
    rows = align_market(bars, proxy).withColumns({"r": simple("close"), "m": simple("market"), "back": back})
    at = lambda k: F.max(F.when(c("back") == k, c("close")))
    year = c("back") <= YEAR
    falling = year & (c("m") < 0)
    n = F.count(F.lit(1))
    change = lambda end, start: F.when(at(start) > 0, at(end) / F.when(at(start) > 0, at(start)) - 1)
    seen = F.count_if(c("market").isNull()) == 0
    return rows.groupBy("ticker").agg(
        F.when(n >= YEAR + 1, change(SKIP + 1, YEAR + 1)).alias("mom12_1"),
        F.when(n >= HALF_YEAR + 1, change(SKIP + 1, HALF_YEAR + 1)).alias("mom6_1"),
        F.when(n >= YEAR + 1, F.stddev_samp(F.when(year, c("r"))) * math.sqrt(YEAR)).alias("low_vol"),
        F.when(n >= REVERSAL + 1, -change(1, REVERSAL + 1)).alias("short_rev"),
        F.when((n >= YEAR + 1) & seen & (F.count_if(falling) >= 2), F.regr_slope(F.when(falling, c("r")), F.when(falling, c("m")))).alias("low_beta"),
        F.when(n >= MONTH, F.avg(F.when((c("back") <= MONTH) & (c("close") > 0), (c("high") - c("low")) / F.when(c("close") > 0, c("close"))))).alias("low_disp"),
    )


def with_fundamentals(factors: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """factors left-joined to fundamentals (ticker and vendor keys or factor names); values that are not finite are null."""
    named = fundamentals.withColumnsRenamed({k: v for k, v in FUNDAMENTALS.items() if k in fundamentals.columns})
    finite = [F.when(F.abs(c(v)) < float("inf"), c(v).cast("double")).alias(v) for v in FUNDAMENTALS.values()]
    return factors.join(named.select("ticker", *finite), "ticker", "left")


def long_form(factors: DataFrame) -> DataFrame:
    """ticker, factor, value."""
    names = [f for f in FACTORS if f in factors.columns]
    return factors.select("ticker", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), c(f).alias("value")) for f in names])).alias("x")).select("ticker", "x.*")


def xs_zscore(values: DataFrame) -> DataFrame:
    """values (ticker, factor, value) with z: clipped at 3 population deviations and standardised again; what is missing or not finite is 0.

    Both passes are windows over one partitioning by factor, so the factors are computed once. A factor's
    cross-section has a row a ticker.
    """
    own = Window.partitionBy("factor")
    raw = values.withColumn("_v", F.when(F.abs("value") < float("inf"), c("value")))
    raw = raw.withColumns({"_mu": F.avg("_v").over(own), "_sd": F.stddev_pop("_v").over(own)})
    clipped = F.greatest(F.least(c("_v"), c("_mu") + WINSOR * c("_sd")), c("_mu") - WINSOR * c("_sd"))
    again = raw.withColumn("_c", F.when(c("_v").isNotNull(), clipped)).withColumns({"_mu2": F.avg("_c").over(own), "_sd2": F.stddev_pop("_c").over(own)})
    z = F.when((c("_sd") > 0) & (c("_sd2") > 0), (c("_c") - c("_mu2")) / F.when(c("_sd2") > 0, c("_sd2")))
    return again.select("ticker", "factor", "value", F.coalesce(z, F.lit(0.0)).alias("z"))


def preset_weights(spark, preset: str) -> DataFrame:
    return spark.createDataFrame([(f, float(w)) for f, w in zip(FACTORS, PRESETS[preset], strict=True)], "factor string, weight double")


def contributions(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """ticker, factor, z, contribution, rank by absolute contribution to nine places, then name; factors of weight 0 are left out."""
    signs = F.create_map(*[F.lit(x) for kv in DIRECTION.items() for x in kv])
    joined = scored.join(F.broadcast(weights.where("weight <> 0")), "factor")  # a row a factor
    parts = joined.select("ticker", "factor", "z", (c("weight") * signs[c("factor")] * c("z")).alias("contribution"))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.round(F.abs("contribution"), 9).desc(), "factor"))
    return parts.withColumn("rank", rank)


def composite_score(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """ticker, score: the sum of weight, direction and z."""
    signs = F.create_map(*[F.lit(x) for kv in DIRECTION.items() for x in kv])
    joined = scored.join(F.broadcast(weights.where("weight <> 0")), "factor")
    return joined.groupBy("ticker").agg(F.sum(c("weight") * signs[c("factor")] * c("z")).alias("score"))


def select_top_n(scores: DataFrame, sectors: DataFrame, n: int, per_sector: int | None = None) -> DataFrame:
    """The n best by score with at most per_sector of one sector; tickers without a sector are not limited, scores that are not finite are skipped."""
    good = scores.where(F.abs("score") < float("inf")).join(sectors.select("ticker", "sector"), "ticker", "left")
    if per_sector is not None:
        place = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("score"), "ticker"))
        good = good.withColumn("_place", place).where(c("sector").isNull() | (c("_place") <= per_sector)).drop("_place")
    return good.orderBy(F.desc("score"), "ticker").limit(n)


def returns_by_date(bars: DataFrame) -> DataFrame:
    """ticker, date, ret with the first row of a ticker left out; a base of 0 or less gives null."""
    row = F.row_number().over(ordered())
    return bars.select("ticker", "date", row.alias("_n"), F.when(prev("close") > 0, c("close") / F.when(prev("close") > 0, prev("close")) - 1).alias("ret")).where("_n > 1").drop("_n")

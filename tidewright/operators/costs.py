"""Transaction costs of changing a position: brokerage, exchange fee, tax or stamp, GST and slippage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import prev

c = F.col

#: Fixed values by instrument class: brokerage, exchange share, tax on sales, stamp on purchases, GST; slippage base, threshold in lots, large.
SCHEDULES = {
    "NSE_FO_STOCK": (20.0, 0.0000183, 0.000125, 0.00002, 0.18, 2.0, 50.0, 8.0),
    "MCX_SINGLE": (20.0, 0.000026, 0.0001, 0.00002, 0.18, 3.0, 10.0, 10.0),
    "MCX_INDEX": (20.0, 0.000026, 0.0, 0.00002, 0.18, 4.0, 20.0, 12.0),
}
FIELDS = ("brokerage", "exchange", "sell_tax", "buy_stamp", "gst", "base_bps", "threshold_lots", "large_bps")


def schedule(field: str, kind: Column | None = None) -> Column:
    """The class's value; a class that is not known has none."""
    kind = c("instrument_class") if kind is None else kind
    found = None
    for name, values in SCHEDULES.items():
        found = (F if found is None else found).when(kind == name, F.lit(values[FIELDS.index(field)]))
    return found


def instrument_class(ticker: Column, kind: Column) -> Column:
    """Of a ticker left-joined to the commodity list, whose kind is null for equities."""
    return F.when(kind.isNull(), "NSE_FO_STOCK").when(kind == "index", "MCX_INDEX").otherwise("MCX_SINGLE")


def slippage_bps(lots: Column) -> Column:
    base, edge, large = schedule("base_bps"), schedule("threshold_lots"), schedule("large_bps")
    over = F.least((lots - edge) / edge, F.lit(1.0))
    return F.when(lots <= edge, base).otherwise(base + over * (large - base))


def leg_cost(sells: Column, lots: Column, price: Column) -> Column:
    """Of one order for lots at a price; 0 without lots or value."""
    value = lots * c("lot_size") * price
    exchange = value * schedule("exchange")
    tax = value * F.when(sells, schedule("sell_tax")).otherwise(schedule("buy_stamp"))
    slip = value * slippage_bps(lots) / 10000
    brokerage = schedule("brokerage")
    return F.when((lots > 0) & (value > 0), brokerage + exchange + tax + (brokerage + exchange) * schedule("gst") + slip).otherwise(0.0)


def trade_costs(daily: DataFrame) -> DataFrame:
    """daily (close, signal, lots, lot_size, instrument_class) with cost: of a flip both legs, else one on the difference."""
    placed = daily.withColumn("_now", c("signal") * c("lots")).withColumn("_before", F.coalesce(prev("_now"), F.lit(0)))
    now, before, price = c("_now"), c("_before"), c("close")
    flips = now * before < 0
    both = leg_cost(before > 0, F.abs(before), price) + leg_cost(now < 0, F.abs(now), price)
    one = leg_cost(now < before, F.abs(now - before), price)
    return placed.withColumn("cost", F.when((now == before) | (price <= 0), 0.0).when(flips, both).otherwise(one)).drop("_now", "_before")

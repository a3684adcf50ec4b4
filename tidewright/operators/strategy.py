"""Back-tests: indicators, rules, signal, rebalancing, position size, costs, profit, trades and metrics as one DataFrame plan."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import half_up, hold, ordered, prefix, prev, ratio, sample_std
from ..plans.config import Rule, Sizing, Strategy
from .costs import trade_costs
from .indicators import REGISTRY, add_indicators
from .recursive import rebalance_days

c = F.col
CAPITAL = 1_000_000.0
YEAR = 252


def _flag(condition: Column, yes: int) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(0))


def rule_raw(rule: Rule, primary: list[str]) -> Column:
    """-1, 0 or 1 on each bar: needs the value and the one before; no holding."""
    now, before = c(primary[rule.indicator]), prev(primary[rule.indicator])
    bound = F.lit(float(rule.threshold or 0))
    target, target_before = (c(primary[rule.reference]), prev(primary[rule.reference])) if rule.reference is not None else (bound, bound)
    fired = {
        "crosses_above": (before <= target_before) & (now > target),
        "crosses_below": (before >= target_before) & (now < target),
        "is_above": now > target,
        "is_below": now < target,
        "between": (now >= bound) & (now <= (target if rule.reference is not None else F.lit(100.0))),
    }[rule.condition]
    upward = rule.condition in ("crosses_above", "is_above")
    yes = 1 if rule.direction == "long" or (rule.direction == "both" and upward) else -1
    no = -yes if rule.direction == "both" and rule.is_level else 0
    there = now.isNotNull() & before.isNotNull() & (target.isNotNull() if rule.is_level else F.lit(True))
    return F.when(there & F.coalesce(fired, F.lit(False)), F.lit(yes)).when(there, F.lit(no)).otherwise(F.lit(0))


def combine(df: DataFrame, rules: tuple[Rule, ...], raw: list[str], logic: str) -> DataFrame:
    """df with signal. or: the last rule that is not 0, levels as they are and others held. and: all held ones that are not 0 agree."""
    if not rules:
        return df.withColumn("signal", F.lit(0))
    held = [c(x) if logic == "or" and r.is_level else hold(c(x)) for r, x in zip(rules, raw, strict=True)]
    df = df.withColumns({f"_h{k}": h for k, h in enumerate(held)})
    names = [c(f"_h{k}") for k in range(len(held))]
    if logic == "or":
        signal = F.coalesce(*[F.nullif(x, F.lit(0)) for x in reversed(names)], F.lit(0))
    else:
        high, low = (F.greatest(*names), F.least(*names)) if len(names) > 1 else (names[0], names[0])
        signal = F.when((high == 1) & (low >= 0), F.lit(1)).when((low == -1) & (high <= 0), F.lit(-1)).otherwise(F.lit(0))
    return df.withColumn("signal", signal).drop(*[f"_h{k}" for k in range(len(held))])


def rebalance(df: DataFrame, frequency: str) -> DataFrame:
    """df with signal as sampled on rebalancing days: each new month; weekly on Mondays or after 7 days; biweekly after 14 days."""
    if frequency == "daily":
        return df
    if frequency == "monthly":
        due = df.withColumn("due", F.coalesce(F.trunc("date", "month") != F.trunc(prev("date"), "month"), F.lit(True)))
    else:
        due = rebalance_days(df, 7 if frequency == "weekly" else 14, frequency == "weekly")
    return due.withColumn("signal", F.last(F.when(c("due"), c("signal")), ignorenulls=True).over(prefix())).drop("due")


def with_lots(df: DataFrame, sizing: Sizing) -> DataFrame:
    """Lots by risk budget over volatility, at least 1 where a signal is on, from row vol_window on."""
    returns = df.withColumns({"_ret": F.coalesce(ratio(c("close") - prev("close"), prev("close"), 0.0), F.lit(0.0)), "_row": F.row_number().over(ordered())})
    risk = returns.withColumn("_risk", c("close") * c("lot_size") * F.greatest(sample_std("_ret", sizing.vol_window), F.lit(0.01)) * sizing.z_multiplier)
    sized = F.greatest(F.floor(sizing.risk_budget / F.when(c("_risk") > 0, c("_risk"))), F.lit(1))
    on = (c("_row") > sizing.vol_window) & (c("signal") != 0) & (c("_risk") > 0)
    return risk.withColumn("lots", F.when(on, sized).otherwise(F.lit(0)).cast("long")).drop("_ret", "_row", "_risk")


def with_pnl(df: DataFrame) -> DataFrame:
    """gross profit of the position held overnight, cost of the day's trades, net, cumulative net and its distance from its peak."""
    gross = F.coalesce(prev("signal") * prev("lots") * c("lot_size") * (c("close") - prev("close")), F.lit(0.0))
    daily = trade_costs(df.withColumn("gross_pnl", gross)).withColumn("net_pnl", c("gross_pnl") - c("cost"))
    summed = daily.withColumn("cumulative", F.sum("net_pnl").over(prefix()))
    return summed.withColumn("drawdown", c("cumulative") - F.max("cumulative").over(prefix()))


def _runs(daily: DataFrame, *more: Column) -> DataFrame:
    """A row a maximal run of equal signal: entry, exit (the first bar after it, or the last bar), and more aggregates of its days."""
    changed = _flag(F.coalesce(c("signal") != prev("signal"), F.lit(True)), 1)
    runs = (
        daily.withColumn("_change", changed)
        .withColumn("run", F.sum("_change").over(prefix()))
        .groupBy("ticker", "run")
        .agg(
            F.first("signal").alias("signal"), F.first("lot_size").alias("lot_size"), F.min("date").alias("entry_date"), F.min_by("close", "date").alias("entry_price"),
            F.min_by("lots", "date").alias("lots"), F.max("date").alias("_last"), F.max_by("close", "date").alias("_last_close"), *more,
        )
    )
    closed = runs.withColumns({"exit_date": F.coalesce(F.lead("entry_date").over(_by_run()), c("_last")), "exit_price": F.coalesce(F.lead("entry_price").over(_by_run()), c("_last_close"))})
    move = c("exit_price") - c("entry_price")
    return closed.withColumns(
        {
            "pnl": c("signal") * c("lots") * c("lot_size") * move,
            "pnl_pct": ratio(move, c("entry_price"), 0.0) * 100 * c("signal"),
            "duration_days": F.greatest(F.datediff("exit_date", "entry_date"), F.lit(1)),
        }
    )


def _by_run():
    return Window.partitionBy("ticker").orderBy("run")


def trade_log(daily: DataFrame) -> DataFrame:
    """A row a run of equal non-zero signal: entered on its first bar, left on the first bar after it or on the last bar."""
    direction = F.when(c("signal") == 1, "long").otherwise("short").alias("direction")
    return _runs(daily).where("signal <> 0").select("ticker", "entry_date", "exit_date", direction, "lots", "entry_price", "exit_price", "pnl", "pnl_pct", "duration_days")


def _with_streaks(runs: DataFrame) -> DataFrame:
    """runs with trade (whether it is one), won (pnl > 0) and streak: its place in the row of trades that end alike."""
    judged = runs.withColumn("trade", c("signal") != 0).withColumn("won", F.when(c("trade"), c("pnl") > 0))
    before = F.last("won", ignorenulls=True).over(_by_run().rowsBetween(Window.unboundedPreceding, -1))
    turns = judged.withColumn("_turn", _flag(c("trade") & F.coalesce(c("won") != before, F.lit(True)), 1))
    islands = turns.withColumn("_island", F.sum("_turn").over(_by_run().rowsBetween(Window.unboundedPreceding, 0)))
    place = Window.partitionBy("ticker", "_island").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("streak", F.count_if("trade").over(place))


def metrics(daily: DataFrame) -> DataFrame:
    """One row a ticker of at least two bars.

    Days are aggregated by run, runs by ticker: daily figures and trades come from one pass under one partitioning.
    """
    earlier = F.coalesce(F.max("cumulative").over(ordered().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    peaks = daily.withColumn("_before", F.greatest(earlier, F.lit(0.0))).withColumns({"_peak": F.greatest("_before", "cumulative"), "_first": F.min("date").over(prefix())})
    dated = peaks.withColumn("_peak_date", F.coalesce(F.last(F.when(c("cumulative") > c("_before"), c("date")), ignorenulls=True).over(prefix()), c("_first")))
    depth, net = c("_peak") - c("cumulative"), c("net_pnl")
    # deviations are taken from the ticker's means, not from sums of squares, which cancel where a mean is large against them
    own, lost_day = Window.partitionBy("ticker"), F.when(net < 0, net)
    dated = dated.withColumns({"_off": net - F.avg("net_pnl").over(own), "_neg_off": lost_day - F.sum(lost_day).over(own) / F.count(F.lit(1)).over(own)})
    deepest = F.struct(depth.alias("depth"), (-F.unix_date("date")).alias("earlier"), (depth / (CAPITAL + c("_peak")) * 100).alias("pct"), F.datediff("date", "_peak_date").alias("days"))
    runs = _with_streaks(
        _runs(
            dated, F.count(F.lit(1)).alias("n"), F.sum("net_pnl").alias("total"), F.sum(c("_off") * c("_off")).alias("squares"), F.sum("cost").alias("costs"),
            F.sum(c("_neg_off") * c("_neg_off")).alias("neg2"), F.count_if(net < 0).alias("neg_n"), F.max(deepest).alias("dd"),
        )
    )
    won, lost = c("won"), c("trade") & ~c("won")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    best = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    total = runs.groupBy("ticker").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.sum("costs").alias("costs"), zero(F.sum("neg2")).alias("neg2"), F.sum("neg_n").alias("neg_n"), F.max("dd").alias("dd"),
        F.count_if("trade").alias("num_trades"), F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"), zero(F.sum(F.when(won, c("pnl")))).alias("profit"), zero(F.sum(F.when(lost, -c("pnl")))).alias("loss"),
        zero(F.avg(F.when(c("trade"), c("duration_days")))).alias("hold_days"), zero(F.max(F.when(c("trade"), c("pnl")))).alias("best"), zero(F.min(F.when(c("trade"), c("pnl")))).alias("worst"),
        best(F.max(F.when(won, c("streak")))).alias("max_consec_wins"), best(F.max(F.when(lost, c("streak")))).alias("max_consec_losses"),
    ).where("n >= 2")
    mean = c("total") / c("n")
    std = F.sqrt(c("squares") / (c("n") - 1))
    downside = F.when(c("neg_n") > 0, F.sqrt(c("neg2") / (c("n") - 1))).otherwise(0.0)
    yearly = c("total") * YEAR / c("n")
    deep, root = c("dd.depth"), math.sqrt(YEAR)
    win, loss = ratio(c("profit"), c("wins"), 0.0), ratio(c("loss"), c("losses"), 0.0)
    four = {
        "sharpe": ratio(mean, std, 0.0) * root, "sortino": ratio(mean, downside, 0.0) * root, "calmar": ratio(yearly, deep, 0.0), "max_dd_pct": F.when(deep > 0, -c("dd.pct")).otherwise(0.0),
        "total_return_pct": c("total") / CAPITAL * 100, "annual_return_pct": yearly / CAPITAL * 100, "payoff_ratio": ratio(win, loss, 0.0),
        "profit_factor": F.when(c("loss") == 0, F.when(c("profit") > 0, F.lit(math.inf)).otherwise(0.0)).otherwise(ratio(c("profit"), c("loss"), 0.0)),
    }
    two = {
        "max_dd_inr": -deep, "total_pnl": c("total"), "win_rate_pct": ratio(100.0 * c("wins"), c("num_trades"), 0.0), "avg_hold_days": c("hold_days"), "avg_trade_pnl": ratio(c("total"), c("num_trades"), 0.0),
        "best_trade": c("best"), "worst_trade": c("worst"), "avg_win": win, "avg_loss": loss, "gross_profit": c("profit"), "gross_loss": c("loss"), "total_costs": c("costs"),
    }
    return total.select(
        "ticker", *[(half_up(x, 4) + 0.0).alias(k) for k, x in four.items()], *[(half_up(x, 2) + 0.0).alias(k) for k, x in two.items()],
        F.when(deep > 0, c("dd.days")).otherwise(0).cast("long").alias("max_dd_duration_days"), *[c(k).cast("long").alias(k) for k in ("num_trades", "max_consec_wins", "max_consec_losses")],
    )


@dataclass(frozen=True)
class BackTest:
    """Lazy results of one strategy over all tickers of bars; bars carry lot_size and instrument_class."""

    bars: DataFrame
    strategy: Strategy

    @cached_property
    def signals(self) -> DataFrame:
        primary = [f"_i{k}_{REGISTRY[i.type].primary}" for k, i in enumerate(self.strategy.indicators)]
        names = [tuple(f"_i{k}_{o}" for o in REGISTRY[i.type].outputs) for k, i in enumerate(self.strategy.indicators)]
        df = add_indicators(self.bars, [(i.type, i.params) for i in self.strategy.indicators], names)
        raw = [f"_r{k}" for k in range(len(self.strategy.rules))]
        df = df.withColumns({x: rule_raw(r, primary) for r, x in zip(self.strategy.rules, raw, strict=True)}) if raw else df
        signal = combine(df, self.strategy.rules, raw, self.strategy.logic).select(*self.bars.columns, "signal")
        return rebalance(signal, self.strategy.rebalance)

    @cached_property
    def daily(self) -> DataFrame:
        return with_pnl(with_lots(self.signals, self.strategy.sizing))

    @cached_property
    def trades(self) -> DataFrame:
        return trade_log(self.daily)

    @cached_property
    def metrics(self) -> DataFrame:
        return metrics(self.daily)

    @cached_property
    def monthly(self) -> DataFrame:
        return self.daily.groupBy("ticker", F.year("date").alias("year"), F.month("date").alias("month")).agg((half_up(F.sum("net_pnl"), 2) + 0.0).alias("pnl"))

    @cached_property
    def yearly(self) -> DataFrame:
        return self.daily.groupBy("ticker", F.year("date").alias("year")).agg((half_up(F.sum("net_pnl"), 2) + 0.0).alias("pnl"))

    @cached_property
    def totals(self) -> DataFrame:
        """ticker, year, month, level, pnl, days, up_days: sums by month (level 0), by year (1, no month) and in all (3, neither), in one aggregation over grouping sets."""
        dated = self.daily.withColumns({"year": F.year("date"), "month": F.month("date")})
        sets = dated.groupingSets([[c("ticker"), c("year"), c("month")], [c("ticker"), c("year")], [c("ticker")]], c("ticker"), c("year"), c("month"))
        return sets.agg(
            F.grouping_id().cast("int").alias("level"), (half_up(F.sum("net_pnl"), 2) + 0.0).alias("pnl"), F.count(F.lit(1)).alias("days"), F.count_if(c("net_pnl") > 0).alias("up_days")
        )


def back_test(bars: DataFrame, dims: DataFrame, strategy: Strategy) -> BackTest:
    """dims: ticker, lot_size, instrument_class."""
    return BackTest(bars.join(dims.select("ticker", "lot_size", "instrument_class"), "ticker"), strategy)

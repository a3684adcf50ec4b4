"""The efficient frontier exactly, by the critical line method.

Weights between bounds that sum to 1 and minimise w'Cw / 2 - slope * w'mu are piecewise linear in the slope. The walk
starts at the largest return (slope without end) and follows the line of the members that are free until one of
them meets a bound, or the gradient of one at a bound turns; there the set of free members changes, and a corner
is kept. It ends at the least variance (slope 0). Between two corners the frontier is their mixture, so a few
corners say all that the projected gradient's points approach. Each step solves one system of the free members.

K x K statistics are aggregated in Spark; a portfolio's matrix is walked by one grouped task. Sectors are not
bounded here. Each corner carries its optimality gap: what the linearised objective could still gain at any
allowed weights, which bounds the distance from the optimum; it is found without the walk's own multipliers.

Defined results: members of one return are told apart by a trifle in name order, so that the start is unique.
Bounds that admit no weights are widened to 1 / K. A portfolio of one member has one corner; one with fewer than
20 common returns has none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .optimizer import TINY, Constraints, _described, _matrices, statistics

#: Corners within this much of the last one's slope are taken for the same one met again.
SAME = 1e-10


@dataclass(frozen=True)
class Corner:
    slope: float
    weights: np.ndarray


def bounds(n: int, k: Constraints) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest weight of each of n members."""
    least = max(0.0, k.min_weight) if k.long_only else k.min_weight
    return np.full(n, min(least, 1 / n)), np.full(n, max(k.max_weight, 1 / n))


def largest(value: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, int]:
    """The weights of largest value, filled up from the best member, and the member that was filled last."""
    w, last = lower.copy(), int(np.argmax(value))
    for i in np.argsort(-value, kind="stable"):
        room = 1 - w.sum()
        if room <= TINY:
            break
        w[i], last = min(upper[i], lower[i] + room), int(i)
    return w, last


def optimality_gap(w: np.ndarray, cov: np.ndarray, mu: np.ndarray, slope: float, lower: np.ndarray, upper: np.ndarray) -> float:
    """How far w'Cw / 2 - slope * w'mu is above its least value, at most."""
    gradient = cov @ w - slope * mu
    return float(gradient @ (w - largest(-gradient, lower, upper)[0]))


def critical_line(cov: np.ndarray, mu: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> list[Corner]:
    """Corners from the largest return to the least variance."""
    order = np.argsort(-mu, kind="stable")
    apart = mu.astype(float).copy()
    for a, b in zip(order, order[1:], strict=False):
        apart[b] = min(apart[b], apart[a] - 1e-12 * max(1.0, abs(apart[a])))
    w, first = largest(apart, lower, upper)
    free = np.zeros(len(mu), bool)
    free[first] = True
    corners, slope, changed = [], np.inf, -1
    for _ in range(50 * len(mu) + 50):
        held = ~free
        inside = cov[np.ix_(free, free)]
        right = np.column_stack([np.ones(free.sum()), apart[free], cov[np.ix_(free, held)] @ w[held]])
        of_one, of_mu, of_held = np.linalg.solve(inside, right).T
        total = of_one.sum()
        level = np.array([1 - w[held].sum() + of_held.sum(), -of_mu.sum()]) / total  # the multiplier: level[0] + slope * level[1]
        start, step = np.zeros((2, len(mu)))
        start[free], step[free] = level[0] * of_one - of_held, of_mu + level[1] * of_one
        start[held] = w[held]
        base, turn = cov @ start - level[0], cov @ step - apart - level[1]  # the gradient less the multiplier: base + slope * turn

        events = np.full(len(mu), -np.inf)
        if free.sum() > 1:
            meets = np.where(step > 0, lower, upper)
            moves = free & (np.abs(step) > TINY)
            events[moves] = (meets[moves] - start[moves]) / step[moves]
        turns = held & np.where(w <= lower, turn > TINY, turn < -TINY) & (upper > lower)
        events[turns] = -base[turns] / turn[turns]
        if changed >= 0 and events[changed] >= slope - SAME * max(1.0, slope):
            events[changed] = -np.inf  # it has just been there
        changed = int(np.argmax(events))
        at = min(events[changed], slope)
        if at <= 0:
            corners.append(Corner(0.0, start))
            return corners
        w = start + at * step
        slope = float(at)
        corners.append(Corner(slope, w.copy()))
        if free[changed]:
            w[changed] = (lower if step[changed] > 0 else upper)[changed]
        free[changed] = not free[changed]
    raise ArithmeticError("the critical line does not end")


def volatility_at(corners: list[Corner], cov: np.ndarray, mu: np.ndarray, target: float) -> float:
    """Least volatility at a return of target or more, NaN above the largest return: that of the mixture of the two corners around it."""
    rewards = np.array([c.weights @ mu for c in corners])
    if target > rewards[0] + TINY:
        return float("nan")
    k = int(np.argmax(rewards <= target)) if (rewards <= target).any() else len(corners) - 1
    if k == 0 or target <= rewards[-1]:
        w = corners[0 if k == 0 else -1].weights
    else:
        share = (target - rewards[k]) / (rewards[k - 1] - rewards[k])
        w = share * corners[k - 1].weights + (1 - share) * corners[k].weights
    return float(np.sqrt(max(w @ cov @ w, 0.0)))


def at_slope(corners: list[Corner], slope: float) -> np.ndarray:
    """The weights of that slope: linear between corners, those of the largest return beyond the first."""
    slopes, weights = np.array([c.slope for c in corners[::-1]]), np.array([c.weights for c in corners[::-1]])
    return np.array([np.interp(slope, slopes, own) for own in weights.T])


def frontier_corners(returns: DataFrame, constraints: Constraints = Constraints()) -> DataFrame:
    """returns: portfolio_id, ticker, date, ret, sector -> a row a corner and member, corners from the largest return down.

    slope is the return's price in variance, gap the corner's optimality gap.
    """

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        names, cov, mu, sigma, _, periods = _matrices(own)
        columns = ["portfolio_id", "corner", "ticker", "weight", "slope", "return", "volatility", "sharpe", "gap"]
        if periods < 20:
            return pd.DataFrame(columns=columns)
        lower, upper = bounds(len(names), constraints)
        rows = []
        for at, c in enumerate(critical_line(cov, mu, lower, upper)):
            d = _described(c.weights, cov, mu, sigma)
            gap = optimality_gap(c.weights, cov, mu, c.slope, lower, upper)
            rows += [(own["portfolio_id"].iloc[0], at, n, w, c.slope, d["expected_return"], d["volatility"], d["sharpe"], gap) for n, w in zip(names, c.weights.tolist(), strict=True)]
        return pd.DataFrame(rows, columns=columns)

    kinds = "portfolio_id string, corner int, ticker string, weight double, slope double, `return` double, volatility double, sharpe double, gap double"
    return statistics(returns).groupBy("portfolio_id").applyInPandas(solve, kinds)


def exact_frontier(returns: DataFrame, constraints: Constraints = Constraints(), points: int = 25) -> DataFrame:
    """returns as for frontier_corners -> portfolio_id, point, return, volatility: the exact frontier at returns spread evenly from the least variance's to the largest."""

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        names, cov, mu, _, _, periods = _matrices(own)
        if periods < 20:
            return pd.DataFrame(columns=["portfolio_id", "point", "return", "volatility"])
        corners = critical_line(cov, mu, *bounds(len(names), constraints))
        targets = np.linspace(corners[-1].weights @ mu, corners[0].weights @ mu, points)
        return pd.DataFrame({"portfolio_id": own["portfolio_id"].iloc[0], "point": range(points), "return": targets, "volatility": [volatility_at(corners, cov, mu, t) for t in targets]})

    return statistics(returns).groupBy("portfolio_id").applyInPandas(solve, "portfolio_id string, point int, `return` double, volatility double")


def frontier_at(returns: DataFrame, slopes: Sequence[float], constraints: Constraints = Constraints()) -> DataFrame:
    """returns as for frontier_corners -> a row a slope and member: the exact portfolio that gives a unit of return that price in variance."""

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        names, cov, mu, sigma, _, periods = _matrices(own)
        columns = ["portfolio_id", "slope", "ticker", "weight", "return", "volatility"]
        if periods < 20:
            return pd.DataFrame(columns=columns)
        corners, rows = critical_line(cov, mu, *bounds(len(names), constraints)), []
        for slope in slopes:
            w = at_slope(corners, slope)
            d = _described(w, cov, mu, sigma)
            rows += [(own["portfolio_id"].iloc[0], float(slope), n, x, d["expected_return"], d["volatility"]) for n, x in zip(names, w.tolist(), strict=True)]
        return pd.DataFrame(rows, columns=columns)

    return statistics(returns).groupBy("portfolio_id").applyInPandas(solve, "portfolio_id string, slope double, ticker string, weight double, `return` double, volatility double")

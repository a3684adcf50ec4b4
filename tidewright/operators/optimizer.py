"""Iterative allocation of K members: K x K statistics are aggregated in Spark, and each portfolio's matrix is solved in numpy by one grouped task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .portfolio import align_returns, pair_table, shrink

YEAR, RF, ROUNDS, CLOSE, TINY = 252, 0.06, 1000, 1e-8, 1e-15
METHODS = ("equal", "inverse_vol", "risk_parity", "min_variance", "max_sharpe", "max_diversification", "target_vol")


@dataclass(frozen=True)
class Constraints:
    min_weight: float = 0.0
    max_weight: float = 0.25
    max_sector: float = 0.40
    long_only: bool = True
    max_positions: int | None = None
    target_vol: float = 0.15


def normalise(w: np.ndarray) -> np.ndarray:
    return w / w.sum() if w.sum() >= TINY else np.full(len(w), 1 / len(w))


def _within(w: np.ndarray, k: Constraints) -> np.ndarray:
    return np.clip(w, max(0.0, k.min_weight) if k.long_only else k.min_weight, k.max_weight)


def cap_sectors(w: np.ndarray, sectors: np.ndarray, most: float) -> np.ndarray:
    """Sectors above most are scaled down to it; what is freed is not given to others."""
    names, of = np.unique(sectors, return_inverse=True)
    sums = np.bincount(of, weights=w, minlength=len(names))
    scale = np.where((sums > most) & (sums > TINY), most / np.where(sums > TINY, sums, 1.0), 1.0)
    return w * scale[of]


def project(w: np.ndarray, sectors: np.ndarray, k: Constraints) -> np.ndarray:
    """Clipped, only the largest positions, sectors capped, summing to 1; the sum comes last, so tight limits can be exceeded."""
    w = _within(w, k)
    if k.max_positions is not None and k.max_positions < len(w):
        w = w.copy()
        w[np.argsort(-w, kind="stable")[k.max_positions :]] = 0
    return normalise(cap_sectors(w, sectors, k.max_sector))


def descend(n: int, objective: Callable, gradient: Callable, feasible: Callable) -> np.ndarray:
    """Projected gradient steps from equal weights: a step that does not improve is dropped and shortens the next ones."""
    w, rate = np.full(n, 1 / n), 0.01
    best = objective(w)
    for step in range(1, ROUNDS + 1):
        slope = gradient(w)
        tried = feasible(w - rate * slope)
        value = objective(tried)
        if value < best:
            best, w = value, tried
        else:
            rate *= 0.95
        if np.linalg.norm(slope) < CLOSE:
            break
        if step % 100 == 0:
            rate *= 0.5
    return w


def _per_risk(cov: np.ndarray, reward: np.ndarray, free: float) -> tuple[Callable, Callable]:
    """Minus (w.reward - free) per volatility, and its gradient."""
    vol = lambda w: np.sqrt(max(w @ cov @ w, TINY))
    value = lambda w: -(w @ reward - free) / vol(w)
    slope = lambda w: (w @ reward - free) * (cov @ w) / vol(w) ** 3 - reward / vol(w)
    return value, slope


def risk_parity(cov: np.ndarray, k: Constraints) -> np.ndarray:
    """Fixed point of weights in proportion to one over the marginal risk."""
    w = np.full(len(cov), 1 / len(cov))
    for _ in range(ROUNDS):
        marginal = cov @ w / np.sqrt(max(w @ cov @ w, TINY))
        inverse = np.where(marginal > TINY, 1 / np.where(marginal > TINY, marginal, 1.0), 0.0)
        if inverse.sum() <= TINY:
            return np.full(len(cov), 1 / len(cov))
        new = normalise(_within(inverse / inverse.sum(), k))
        moved, w = np.abs(new - w).max(), new
        if moved < CLOSE:
            break
    return w


def allocate(method: str, cov: np.ndarray, mu: np.ndarray, sigma: np.ndarray, sectors: np.ndarray, k: Constraints) -> np.ndarray:
    """Weights by annual covariances, returns and deviations; an unknown method is equal weights."""
    n = len(mu)
    feasible = lambda w: project(w, sectors, k)
    if method == "inverse_vol":
        w = normalise(np.where(sigma > 1e-10, 1 / np.where(sigma > 1e-10, sigma, 1.0), 0.0))
    elif method == "risk_parity":
        w = risk_parity(cov, k)
    elif method == "min_variance":
        w = descend(n, lambda w: w @ cov @ w, lambda w: 2 * cov @ w, feasible)
    elif method in ("max_sharpe", "target_vol"):
        w = descend(n, *_per_risk(cov, mu, RF), feasible)
        if method == "target_vol" and (vol := np.sqrt(max(w @ cov @ w, TINY))) >= 1e-10:
            w = normalise(w * k.target_vol / vol)
    elif method == "max_diversification":
        w = descend(n, *_per_risk(cov, sigma, 0.0), feasible)
    else:
        w = np.full(n, 1 / n)
    return project(w, sectors, k)


def at_return(cov: np.ndarray, mu: np.ndarray, target: float, sectors: np.ndarray, k: Constraints, penalty: float = 100.0) -> np.ndarray:
    """Least variance with a penalty on missing the target return."""
    off = lambda w: w @ mu - target
    w = descend(len(mu), lambda w: w @ cov @ w + penalty * off(w) ** 2, lambda w: 2 * (cov @ w + penalty * off(w) * mu), lambda w: project(w, sectors, k))
    return project(w, sectors, k)


def _described(w: np.ndarray, cov: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> dict[str, float]:
    variance, reward = max(w @ cov @ w, 0.0), float(w @ mu)
    vol = float(np.sqrt(variance))
    return {"expected_return": reward, "volatility": vol, "sharpe": (reward - RF) / vol if vol > 1e-10 else 0.0, "diversification_ratio": float(w @ sigma) / vol if vol > TINY else 1.0}


def statistics(returns: DataFrame) -> DataFrame:
    """portfolio_id, i, j, cov, periods, mu, sigma, sector: shrunk annual covariances of each two members, and on the diagonal annual return, deviation and sector.

    K x K rows a portfolio, aggregated in Spark from portfolio_id, ticker, date, ret, sector.
    """
    by = ["portfolio_id"]
    own = F.col("i") == F.col("j")
    found = pair_table(
        align_returns(returns, by),
        F.coalesce(F.covar_samp("x", "y"), F.lit(0.0)).alias("cov"), F.count(F.lit(1)).alias("periods"), (F.avg("x") * YEAR).alias("mu"), (F.coalesce(F.stddev_samp("x"), F.lit(0.0)) * np.sqrt(YEAR)).alias("sigma"),
        by=by,
    )
    sectors = returns.groupBy(*by, F.col("ticker").alias("i")).agg(F.coalesce(F.min("sector"), F.lit("")).alias("sector"))
    only = {x: F.when(own, F.col(x)) for x in ("mu", "sigma")}
    return shrink(found, by).withColumns({"cov": F.col("cov") * YEAR, **only}).join(sectors, [*by, "i"])


def _matrices(own: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Members in name order, covariances, returns, deviations, sectors and periods of one portfolio's statistics."""
    cov = own.pivot(index="i", columns="j", values="cov").sort_index(axis=0).sort_index(axis=1)
    diagonal = own[own["i"] == own["j"]].sort_values("i")
    return list(cov.index), cov.to_numpy(), diagonal["mu"].to_numpy(), diagonal["sigma"].to_numpy(), diagonal["sector"].to_numpy(), int(own["periods"].iloc[0])


def optimise(returns: DataFrame, method: str, constraints: Constraints = Constraints()) -> DataFrame:
    """returns: portfolio_id, ticker, date, ret, sector -> a row a member with weight, risk_contribution and the portfolio's figures.

    One member has weight 1; with fewer than 20 common returns the weights are equal.
    """

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        names, cov, mu, sigma, sectors, periods = _matrices(own)
        n = len(names)
        w = np.ones(1) if n == 1 else np.full(n, 1 / n) if periods < 20 else allocate(method, cov, mu, sigma, sectors, constraints)
        total = w @ cov @ w
        shares = w * (cov @ w) / total if total > TINY else np.zeros(n)
        return pd.DataFrame({"portfolio_id": own["portfolio_id"].iloc[0], "ticker": names, "weight": w, "risk_contribution": shares, **_described(w, cov, mu, sigma)})

    return statistics(returns).groupBy("portfolio_id").applyInPandas(solve, "portfolio_id string, ticker string, weight double, risk_contribution double, expected_return double, volatility double, sharpe double, diversification_ratio double")


def efficient_frontier(returns: DataFrame, constraints: Constraints = Constraints(), points: int = 25) -> DataFrame:
    """returns as for optimise -> a row a point: target returns from the least to the largest member's, by volatility, none within 0.001 of the last kept."""

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        names, cov, mu, sigma, sectors, periods = _matrices(own)
        columns = ["portfolio_id", "point", "return", "volatility", "sharpe", "weights"]
        if len(names) < 2 or periods < 20:
            return pd.DataFrame(columns=columns)
        flat = mu.max() - mu.min() < 1e-10
        found = [allocate("min_variance", cov, mu, sigma, sectors, constraints)] if flat else [at_return(cov, mu, t, sectors, constraints) for t in np.linspace(mu.min(), mu.max(), points)]
        rows, last = [], -np.inf
        for w, d in sorted(((w, _described(w, cov, mu, sigma)) for w in found), key=lambda x: x[1]["volatility"]):
            if d["volatility"] - last > 0.001:
                last = d["volatility"]
                rows.append((own["portfolio_id"].iloc[0], len(rows), d["expected_return"], last, d["sharpe"], w.tolist()))
        return pd.DataFrame(rows, columns=columns)

    return statistics(returns).groupBy("portfolio_id").applyInPandas(solve, "portfolio_id string, point int, `return` double, volatility double, sharpe double, weights array<double>")


def members(returns: DataFrame, sectors: DataFrame, portfolio_id: str = "all") -> DataFrame:
    """ticker, date, ret with sector and a portfolio_id, as optimise takes them."""
    return returns.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("portfolio_id", F.lit(portfolio_id))

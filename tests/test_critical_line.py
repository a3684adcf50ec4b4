"""The exact frontier against all active sets, its optimality conditions, and the projected gradient."""

from itertools import product

import numpy as np
import pandas as pd
import pytest

from tidewright.operators import optimizer
from tidewright.operators.critical_line import at_slope, bounds, critical_line, exact_frontier, frontier_corners, optimality_gap, volatility_at


def problem(n, seed, tie=False):
    r = np.random.default_rng(seed)
    x = r.normal(0.0005, 0.01, size=(200, n)) + r.normal(0, 0.008, size=(200, 1))
    mu = x.mean(axis=0) * 252
    return np.cov(x, rowvar=False) * 252, np.round(mu, 1) if tie else mu


def least_variance(cov, mu, target, lower, upper):
    """The least variance at a return of target, by all sets of members at their bounds."""
    n, best = len(mu), np.inf
    for state in product((-1, 0, 1), repeat=n):
        s = np.array(state)
        free = s == 0
        w = np.where(s < 0, lower, upper)
        a = np.vstack([np.ones(n), mu])
        rest = np.array([1.0, target]) - a[:, ~free] @ w[~free]
        if free.any():
            m = free.sum()
            system = np.block([[cov[np.ix_(free, free)], a[:, free].T], [a[:, free], np.zeros((2, 2))]])
            found = np.linalg.lstsq(system, np.concatenate([-cov[np.ix_(free, ~free)] @ w[~free], rest]), rcond=None)[0]
            w = w.copy()
            w[free] = found[:m]
        if np.abs(a @ w - [1.0, target]).max() < 1e-9 and (w >= lower - 1e-9).all() and (w <= upper + 1e-9).all():
            best = min(best, w @ cov @ w)
    return best


@pytest.mark.parametrize("most", [1.0, 0.4, 0.25])
@pytest.mark.parametrize("seed", range(4))
def test_equals_the_best_of_all_active_sets(most, seed):
    cov, mu = problem(5, seed)
    lower, upper = bounds(5, optimizer.Constraints(max_weight=most))
    corners = critical_line(cov, mu, lower, upper)
    for target in np.linspace(corners[-1].weights @ mu, corners[0].weights @ mu, 9):
        assert volatility_at(corners, cov, mu, target) ** 2 == pytest.approx(least_variance(cov, mu, target, lower, upper), rel=1e-6)


@pytest.mark.parametrize("n, most, least, tie", [(1, 0.25, 0, False), (2, 0.25, 0, False), (4, 0.25, 0, False), (30, 0.25, 0, False), (30, 0.1, 0.01, False), (120, 0.05, 0, False), (40, 1.0, 0, True), (40, 0.2, -0.1, False)])
def test_corners_meet_the_conditions_of_the_optimum(n, most, least, tie):
    for seed in range(5):
        cov, mu = problem(n, seed, tie) if n > 1 else (np.array([[0.04]]), np.array([0.1]))
        lower, upper = bounds(n, optimizer.Constraints(min_weight=least, max_weight=most, long_only=least >= 0))
        corners = critical_line(cov, mu, lower, upper)
        slopes = [c.slope for c in corners]
        assert slopes == sorted(slopes, reverse=True) and slopes[-1] == 0
        for c in corners:
            assert c.weights.sum() == pytest.approx(1) and (c.weights >= lower - 1e-9).all() and (c.weights <= upper + 1e-9).all()
            assert abs(optimality_gap(c.weights, cov, mu, c.slope, lower, upper)) < 1e-8 * max(1.0, c.slope)


def test_projected_gradient_lies_above_and_close():
    cov, mu = problem(6, 3)
    k = optimizer.Constraints(max_weight=0.4, max_sector=1.0)
    corners = critical_line(cov, mu, *bounds(6, k))
    for target in np.linspace(corners[-1].weights @ mu, corners[0].weights @ mu, 7):
        w = optimizer.at_return(cov, mu, target, np.array(list("aabbcc")), k)
        exact = volatility_at(corners, cov, mu, w @ mu)
        assert exact - 1e-9 <= np.sqrt(w @ cov @ w) <= exact + 0.01
    assert np.isnan(volatility_at(corners, cov, mu, mu.max() + 1))


def test_weights_between_corners_are_optimal_too():
    cov, mu = problem(20, 5)
    lower, upper = bounds(20, optimizer.Constraints(max_weight=0.2))
    corners = critical_line(cov, mu, lower, upper)
    for slope in (0.0, 0.01, 0.1, 0.5, 2.0, 100.0):
        assert abs(optimality_gap(at_slope(corners, slope), cov, mu, slope, lower, upper)) < 1e-8 * max(1.0, slope)


def test_two_portfolios_in_spark(spark):
    r = np.random.default_rng(7)
    days = pd.date_range("2024-01-01", periods=60).date
    rows = [(p, f"t{k}", d, float(r.normal(0.001 * k, 0.01)), "s") for p, n in (("p", 5), ("q", 3), ("one", 1)) for k in range(n) for d in days] + [("short", t, d, 0.01, "s") for t in "ab" for d in days[:10]]
    returns = spark.createDataFrame(rows, "portfolio_id string, ticker string, date date, ret double, sector string")
    k = optimizer.Constraints(max_weight=0.5)
    got = frontier_corners(returns, k).toPandas()
    assert set(got["portfolio_id"]) == {"p", "q", "one"} and got["gap"].abs().max() < 1e-8
    assert got.groupby(["portfolio_id", "corner"])["weight"].sum().tolist() == pytest.approx([1.0] * got.groupby(["portfolio_id", "corner"]).ngroups)
    assert got[got["portfolio_id"] == "one"]["weight"].tolist() == pytest.approx([1.0])
    points = exact_frontier(returns, k, points=5).toPandas()
    assert points.groupby("portfolio_id").size().to_dict() == {"p": 5, "q": 5, "one": 5}
    assert (points.sort_values("point").groupby("portfolio_id")["volatility"].apply(lambda v: (v.diff().dropna() >= -1e-12).all())).all()
    assert frontier_corners(returns.limit(0), k).count() == 0

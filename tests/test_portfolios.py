"""Several portfolios at once, and covariances by tiles, against one portfolio at a time and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import portfolio

from .test_scan import series


@pytest.mark.parametrize("tile, dates", [(3, 7), (256, 1024)])
def test_tiled_covariances_equal_numpy(spark, tile, dates):
    x = np.random.default_rng(4).normal(1000.0, 0.01, size=(20, 8))  # a mean far above the deviation
    rows = [(p, f"m{k:02d}", t + 1, float(x[t, k]) * (1 if p == "p" else 2)) for p in "pq" for t in range(20) for k in range(8 if p == "p" else 4)]
    aligned = spark.createDataFrame(rows, "portfolio_id string, ticker string, t long, ret double")
    got = {(r["portfolio_id"], r["i"], r["j"]): (r["cov"], r["periods"]) for r in portfolio.tiled_covariance(aligned, ["portfolio_id"], tile, dates).collect()}
    assert len(got) == 64 + 16 and all(n == 20 for _, n in got.values())
    for p, k, scale in (("p", 8, 1), ("q", 4, 4)):
        want = np.cov(x[:, :k], rowvar=False) * scale
        assert [[got[p, f"m{i:02d}", f"m{j:02d}"][0] for j in range(k)] for i in range(k)] == [pytest.approx(row, rel=1e-9) for row in want.tolist()]


def test_tiled_covariances_equal_the_pair_form_without_a_key(spark):
    aligned = portfolio.align_tail(series(spark, 60, ("a", "b", "c")))
    pairs = {(r["i"], r["j"]): r["cov"] for r in portfolio.covariance(aligned).collect()}
    assert {(r["i"], r["j"]): r["cov"] for r in portfolio.tiled_covariance(aligned, tile=2, dates=5).collect()} == pytest.approx(pairs)
    assert portfolio.tiled_covariance(aligned.limit(0)).count() == 0


def test_many_members_in_tiles(spark):
    members, days = 600, 40
    aligned = spark.range(members * days).select(F.concat(F.lit("m"), F.lpad((F.col("id") % members).cast("string"), 4, "0")).alias("ticker"), (F.floor(F.col("id") / members) + 1).alias("t"), F.sin(F.col("id") * 0.7).alias("ret"))
    got = portfolio.tiled_covariance(aligned, tile=128, dates=16)
    x = np.sin(np.arange(members * days) * 0.7).reshape(days, members)
    assert got.count() == members * members
    want = np.cov(x, rowvar=False)
    for r in got.where("i in ('m0003', 'm0500') and j in ('m0000', 'm0599', 'm0500')").collect():
        assert r["cov"] == pytest.approx(want[int(r["i"][1:]), int(r["j"][1:])], rel=1e-9)


def test_portfolios_together_equal_each_alone(spark):
    bars = series(spark, 200, ("a", "b", "c")).where("not (ticker = 'c' and dayofmonth(date) = 4)")
    weights = {"one": {"a": 0.5, "b": 0.5}, "two": {"a": 0.2, "b": 0.3, "c": 0.5}}
    all_of = spark.createDataFrame([(p, t, w) for p, own in weights.items() for t, w in own.items()], "portfolio_id string, ticker string, weight double")
    together, by = portfolio.portfolio_series(bars, all_of), ["portfolio_id"]
    for p, own in weights.items():
        mine = bars.where(F.col("ticker").isin(*own))
        alone = portfolio.equity(portfolio.portfolio_returns(portfolio.date_intersection(mine, len(own)), spark.createDataFrame(list(own.items()), "ticker string, weight double")))
        for many, single in (
            (together, alone), (portfolio.rolling_sharpe(together, 10, by=by), portfolio.rolling_sharpe(alone, 10)), (portfolio.rolling_volatility(together, 10, by=by), portfolio.rolling_volatility(alone, 10)),
            (portfolio.risk_summary(together, by=by), portfolio.risk_summary(alone)), (portfolio.top_drawdowns(together, 3, by), portfolio.top_drawdowns(alone, 3)),
        ):
            got = sorted(many.where(F.col("portfolio_id") == p).drop("portfolio_id").select(*single.columns).collect(), key=str)
            for x, y in zip(got, sorted(single.collect(), key=str), strict=True):
                assert all(a == pytest.approx(b, rel=1e-9) if isinstance(a, float) else a == b for a, b in zip(x, y, strict=True))

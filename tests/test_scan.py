"""Block scans against the sequential kernels, and series that are longer than any block."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import recursive, scan
from tidewright.operators.indicators import REGISTRY, indicator, indicator_in_blocks


def series(spark, n, tickers=("a", "b")):
    r = np.random.default_rng(3)
    rows = []
    for k, t in enumerate(tickers):
        close = 100 + np.cumsum(r.normal(size=n // (k + 1)))
        for i, x in enumerate(close.tolist()):
            rows.append((t, datetime.date(2000, 1, 1) + datetime.timedelta(days=3 * i), x - 0.5, x + 1 + i % 3, x - 2, x, 10.0 * i))
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("key", scan.SCANS)
def test_blocks_equal_the_sequential_kernel(spark, key):
    bars = series(spark, 260)
    got = sorted(indicator_in_blocks(bars, key).collect())
    want = sorted(indicator(bars, key).collect())
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert x[:2] == y[:2] and all((a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)) for a, b in zip(x[2:], y[2:]))


@pytest.mark.parametrize("size", [1, 2, 7])
def test_any_block_size_gives_the_same(spark, size):
    bars = series(spark, 90, ("a",))
    blocks = F.floor(F.datediff("date", F.lit("2000-01-01").cast("date")) / (3 * size))
    for key in ("macd", "adx", "chaikin_vol", "heikin_ashi"):
        got = sorted(indicator_in_blocks(bars, key, blocks).collect())
        for x, y in zip(got, sorted(indicator(bars, key).collect())):
            assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)) for a, b in zip(x[2:], y[2:]))


def test_series_shorter_than_the_period_and_empty_ones(spark):
    bars = series(spark, 8, ("a",))
    assert indicator_in_blocks(bars, "ema").where("value is not null").count() == 0
    assert indicator_in_blocks(bars.limit(0), "rsi").count() == 0


def test_one_long_ticker_in_blocks(spark):
    n, block = 1_000_000, 20_000
    x = F.sin(F.col("id") / 50) * 10 + 100
    bars = spark.range(n).select(F.lit("a").alias("ticker"), F.col("id").alias("date"), *[x.alias(p) for p in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    rows, outputs = scan.ema(scan.numbered(bars, F.floor(F.col("date") / block)), {"period": 20})
    got = rows.select("date", "_block", outputs["value"].alias("value")).where(F.col("date") % 9973 == 0).orderBy("date").collect()
    want = recursive.ema(np.sin(np.arange(n) / 50) * 10 + 100, 20)
    assert max(r["_block"] for r in got) == n // block - 1
    assert [r["value"] for r in got if r["date"] >= 19] == pytest.approx([want[r["date"]] for r in got if r["date"] >= 19], rel=1e-12)


def test_bars_are_dealt_out_by_ticker_and_block_only(spark):
    plan = indicator_in_blocks(series(spark, 50), "ema")._jdf.queryExecution().executedPlan().toString()
    dealt = {line.split("hashpartitioning(")[1].split(", 4")[0] for line in plan.splitlines() if "hashpartitioning(" in line}
    assert any("ticker" in d and "_block" in d for d in dealt)
    assert REGISTRY["ema"].kernel is not None

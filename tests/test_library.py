import json
import math
import subprocess
import sys
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import fmt
from tidewright.operators import costs, factors, optimizer, portfolio, recursive
from tidewright.operators.indicators import REGISTRY, add_indicators, indicator
from tidewright.operators.strategy import back_test
from tidewright.plans import config
from tidewright.plans.config import Block, Rule, Strategy, blocks_to_strategy
from tidewright.sources import bars as bar_source
from tidewright.sources import etl, registry, store
from tidewright.streaming import bars as stream

BARS = "ticker string, date date, open double, high double, low double, close double, volume double"


def trending(spark, ticker="A", n=260, drift=0.002, start=100.0):
    p, rows = start, []
    for i in range(n):
        p = p * (1 + drift) + 0.005 * p * math.sin(0.37 * i)
        c = round(p, 2)
        rows.append((ticker, date(2020, 1, 1) + timedelta(days=i), c, c * 1.005, c * 0.995, c, 1e6))
    return spark.createDataFrame(rows, BARS)


def flat(spark, n=60):
    return spark.createDataFrame([("F", date(2020, 1, 1) + timedelta(days=i), 100.0, 100.0, 100.0, 100.0, 0.0) for i in range(n)], BARS)


def dims(spark):
    return spark.createDataFrame([(t, 10, "NSE_FO_STOCK") for t in "ABF"], "ticker string, lot_size int, instrument_class string")


def test_flat_prices_have_the_stated_values(spark):
    want = {"rsi": 100.0, "williams_r": -50.0, "price_vs_high_low": 50.0, "z_score": 0.0, "cci": 0.0, "mfi": 100.0, "cmf": 0.0, "vwap": 100.0, "vwma": 100.0, "bb_pct_b": None, "tsi": None, "roc": 0.0, "stoch_rsi": 50.0}
    for key, value in want.items():
        assert indicator(flat(spark), key).orderBy(F.desc("date")).first()[2] == value, key
    assert all(r.value is None for r in indicator(flat(spark), "no_such_type").collect())


def test_short_series_are_all_warm_up(spark):
    bars = flat(spark, 5)
    for key, spec in REGISTRY.items():
        rows = indicator(bars, key).collect()
        assert len(rows) == 5
        if any(v > 5 for v in spec.defaults.values()) and key not in ("ichimoku",):
            assert all(r[2] is None for r in rows), key


def test_equal_indicators_are_computed_once(spark):
    df = add_indicators(trending(spark), [("ema", {"period": 9}), ("ema", {"period": 9.0}), ("sma", {})], [("a",), ("b",), ("c",)])
    rows = df.collect()
    assert all(r.a == r.b for r in rows) and df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1


def test_ema_and_rsi_by_hand():
    x = np.array([1.0, 2, 3, 4, 5])
    assert recursive.ema(x, 3).tolist()[2:] == [2.0, 3.0, 4.0] and np.isnan(recursive.ema(x, 3)[:2]).all()
    assert np.isnan(recursive.ema(x, 6)).all()
    assert recursive._rsi(np.array([1.0, 2, 1, 2]), 2).tolist()[2:] == [50.0, 75.0]


def test_backtest_properties(spark):
    strategy = config.PRESETS["golden_cross"]
    bars = trending(spark).union(trending(spark, "B", 300, -0.002))
    result = back_test(bars, dims(spark), strategy)
    daily = result.daily.orderBy("ticker", "date").collect()
    assert all(r.drawdown <= 0 for r in daily)
    end = {r.ticker: r.cumulative for r in daily}
    metrics = {r.ticker: r for r in result.metrics.collect()}
    assert set(metrics) == {"A", "B"} and all(abs(end[t] - m.total_pnl) < 0.01 for t, m in metrics.items())
    assert all(r.direction in ("long", "short") and r.duration_days >= 1 for r in result.trades.collect())
    assert result.monthly.groupBy("ticker").agg(F.sum("pnl")).count() == 2 and result.yearly.count() >= 2
    assert back_test(flat(spark, 1), dims(spark), strategy).metrics.count() == 0
    none = back_test(flat(spark), dims(spark), Strategy((), ())).metrics.first()
    assert none.num_trades == 0 and none.total_pnl == 0 and none.sharpe == 0


def test_rebalancing_less_often_flips_less(spark):
    rules = (Rule(0, "is_above", reference=1),)
    flips = {}
    for often in config.REBALANCE:
        s = Strategy((config.IndicatorConfig("close_price"), config.IndicatorConfig("sma", {"period": 5})), rules, rebalance=often)
        signal = [r.signal for r in back_test(trending(spark, drift=0.0), dims(spark), s).signals.orderBy("date").collect()]
        flips[often] = sum(a != b for a, b in zip(signal, signal[1:]))
    assert flips["daily"] >= flips["weekly"] >= flips["biweekly"] and flips["weekly"] >= flips["monthly"]


def test_costs(spark):
    df = spark.createDataFrame([("NSE_FO_STOCK", 100, float(n)) for n in (0, 10, 50, 75, 100, 500)], "instrument_class string, lot_size int, lots double")
    bps = [r[0] for r in df.select(costs.slippage_bps(F.col("lots"))).collect()]
    assert bps == [2, 2, 2, 5, 8, 8]
    buy, sell = df.where("lots = 10").select(costs.leg_cost(F.lit(False), F.col("lots"), F.lit(100.0)), costs.leg_cost(F.lit(True), F.col("lots"), F.lit(100.0))).first()
    value = 10 * 100 * 100.0
    assert buy == pytest.approx(20 + value * 0.0000183 + value * 0.00002 + (20 + value * 0.0000183) * 0.18 + value * 2 / 1e4) and sell > buy
    assert df.where("lots = 0").select(costs.leg_cost(F.lit(True), F.col("lots"), F.lit(100.0))).first()[0] == 0


def test_blocks():
    sma = config.default_blocks("sma")
    s = blocks_to_strategy(sma)
    assert [i.type for i in s.indicators] == ["close_price", "sma"] and s.rules == (Rule(0, "is_above", reference=1),)
    rsi = config.default_blocks("rsi")
    assert blocks_to_strategy(rsi).rules == (Rule(0, "is_above", threshold=50),)
    assert blocks_to_strategy([]) is None and config.valid_order(rsi) and not config.valid_order(rsi[::-1])
    assert config.remove_cascade(sma + rsi, sma[0].id) == rsi
    assert len(config.duplicate(rsi, rsi[0].id)) == 4 and config.label("macd", {}) == "MACD(12,26,9)" and config.label("obv", {}) == "OBV"
    lost = [Block("t", "trigger", source="gone"), *rsi]
    assert len(blocks_to_strategy(lost).rules) == 1 and len(config.warnings(lost)) == 1
    for preset in config.PRESETS.values():
        assert blocks_to_strategy(config.strategy_to_blocks(preset), rebalance=preset.rebalance, logic=preset.logic).indicators[-1] == preset.indicators[-1]
    with pytest.raises(ValueError):
        Rule(0, "touches")


def test_top_n_keeps_the_sector_cap(spark):
    scores = spark.createDataFrame([(f"t{k:02d}", float(-k)) for k in range(20)] + [("nan", float("nan")), ("none", None)], "ticker string, score double")
    sectors = spark.createDataFrame([(f"t{k:02d}", "x" if k < 10 else "y") for k in range(18)], "ticker string, sector string")
    got = [r.ticker for r in factors.select_top_n(scores, sectors, 8, 3).collect()]
    assert got == ["t00", "t01", "t02", "t10", "t11", "t12", "t18", "t19"]


def test_zscore_edges(spark):
    rows = [(f"t{k}", "a", 0.0) for k in range(9)] + [("t9", "a", 1000.0), ("u1", "b", None), ("u2", "b", float("inf")), ("v1", "c", 5.0), ("v2", "c", 5.0)]
    z = {(r.ticker, r.factor): r.z for r in factors.xs_zscore(spark.createDataFrame(rows, "ticker string, factor string, value double")).collect()}
    assert abs(z["t9", "a"]) <= 3.01 and z["u1", "b"] == z["u2", "b"] == z["v1", "c"] == 0


def _universe(n, t, seed=1):
    r = np.random.default_rng(seed)
    return r.normal(0.0005, 0.01, (n, t)) * np.linspace(0.5, 2, n)[:, None]


def _annual(returns):
    n, t = returns.shape
    cov = np.cov(returns, ddof=1)
    a = min(max(n / (n + t), 0.01), 0.5)
    return ((1 - a) * cov + a * np.trace(cov) / n * np.eye(n)) * 252, returns.mean(axis=1) * 252, returns.std(axis=1, ddof=1) * math.sqrt(252)


def test_statistics_of_returns(spark):
    returns = _universe(4, 60)
    rows = [("p", t, date(2020, 1, 1) + timedelta(days=d), float(x), "ab"[k % 2]) for k, t in enumerate("wxyz") for d, x in enumerate(returns[k])]
    rows += [("p", "w", date(2019, 12, 1), 5.0, "a")]  # older than the common length
    found = optimizer.statistics(spark.createDataFrame(rows, "portfolio_id string, ticker string, date date, ret double, sector string")).toPandas()
    cov, mu, sigma = _annual(returns)
    for r in found.itertuples():
        i, j = "wxyz".index(r.i), "wxyz".index(r.j)
        assert r.cov == pytest.approx(cov[i, j]) and r.periods == 60 and r.sector == "ab"[i % 2]
        if i == j:
            assert (r.mu, r.sigma) == pytest.approx((mu[i], sigma[i]))
    assert len(found) == 16


def _plain_allocation(method, cov, mu, sigma, sectors):
    """The same methods in plain loops over lists."""
    n = len(mu)
    rng = range(n)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    times = lambda w: [dot(cov[i], w) for i in rng]
    unit = lambda w: [x / sum(w) for x in w] if sum(w) >= 1e-15 else [1 / n] * n
    clip = lambda w: [min(max(x, 0.0), 0.25) for x in w]

    def feasible(w):
        w = clip(w)
        total = {s: sum(x for x, t in zip(w, sectors) if t == s) for s in set(sectors)}
        return unit([x * 0.4 / total[s] if total[s] > 0.4 else x for x, s in zip(w, sectors)])

    def search(value, slope):
        w, rate = [1 / n] * n, 0.01
        best = value(w)
        for step in range(1, 1001):
            g = slope(w)
            tried = feasible([x - rate * y for x, y in zip(w, g)])
            if value(tried) < best:
                best, w = value(tried), tried
            else:
                rate *= 0.95
            if math.sqrt(dot(g, g)) < 1e-8:
                break
            if step % 100 == 0:
                rate /= 2
        return w

    def ratio_of(reward, free):
        vol = lambda w: math.sqrt(max(dot(w, times(w)), 1e-15))
        gain = lambda w: dot(w, reward) - free
        return search(lambda w: -gain(w) / vol(w), lambda w: [gain(w) * s / vol(w) ** 3 - r / vol(w) for s, r in zip(times(w), reward)])

    if method == "min_variance":
        w = search(lambda w: dot(w, times(w)), lambda w: [2 * x for x in times(w)])
    elif method == "max_diversification":
        w = ratio_of(sigma, 0.0)
    elif method in ("max_sharpe", "target_vol"):
        w = ratio_of(mu, 0.06)
        if method == "target_vol":
            w = unit([x * 0.15 / math.sqrt(dot(w, times(w))) for x in w])
    else:
        w = [1 / n] * n
        for _ in range(1000):
            risk = [x / math.sqrt(dot(w, times(w))) for x in times(w)]
            new = unit(clip(unit([1 / x if x > 1e-15 else 0.0 for x in risk])))
            moved, w = max(abs(a - b) for a, b in zip(new, w)), new
            if moved < 1e-8:
                break
    return feasible(w)


@pytest.mark.parametrize("method", ["risk_parity", "min_variance", "max_sharpe", "max_diversification", "target_vol"])
def test_allocations_equal_plain_loops(method):
    cov, mu, sigma = _annual(_universe(6, 200))
    sectors = list("aabbcc")
    want = _plain_allocation(method, cov.tolist(), mu.tolist(), sigma.tolist(), sectors)
    assert optimizer.allocate(method, cov, mu, sigma, np.array(sectors), optimizer.Constraints()) == pytest.approx(want, abs=1e-6)


def test_exact_and_decimal_formats(spark):
    from tidewright.functions import fmt

    values = [1.005, 2.675, 0.125, 0.375, 0.5, 1.5, 2.5, 0.25, 0.35, -0.125, -2.675, 1234567.125, 99999.995, 0.045, None]
    exact = lambda x, d: None if x is None else str(Decimal(x).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (0, 1, 2):
        assert [r[0] for r in df.select(fmt.fixed(F.col("v"), d)).collect()] == [exact(v, d) for v in values]
    shown = [r[0] for r in df.select(fmt.format_price(F.col("v"))).collect()]
    assert shown[:3] == ["₹1.01", "₹2.68", "₹0.13"] and shown[11] == "₹12,34,567.13" and shown[-1] == "—"


def test_files_without_a_ticker_csv_and_few_news(spark, tmp_path):
    (tmp_path / "ABC.json").write_text('{"dates": ["2020-01-01"], "open": [1.0], "high": [1.0], "low": [1.0], "close": [2.0], "volume": [3.0]}')
    (tmp_path / "x.json").write_text('{"ticker": "DEF", "dates": ["2020-01-01"], "open": [1.0], "high": [1.0], "low": [1.0], "close": [2.0], "volume": [3.0]}')
    (tmp_path / "bad.json").write_text("{")
    assert sorted(r.ticker for r in bar_source.scan_prices_json(spark, f"{tmp_path}/*.json").collect()) == ["ABC", "DEF"]
    assert bar_source.preload(spark, f"{tmp_path}/*.json").count() == 2 and bar_source.is_preloaded(spark)
    bar_source.clear(spark)
    bar_source.clear(spark)
    assert not bar_source.is_preloaded(spark)
    assert etl.csv_lines(spark.createDataFrame([], "x string"), ["x"]).count() == 0
    with pytest.raises(ValueError):
        etl.write_news(spark.range(19), str(tmp_path / "news"))


def test_words_of_any_script_in_news(spark):
    stocks = spark.createDataFrame([("ENTRE", "Entre Group"), ("M&M", "Mahindra")], "ticker string, name string")
    titles = ["une entreé ici", "Entre nous", "xentre", "the M&M car", "éM&M", "m&m"]
    items = spark.createDataFrame([(t, str(k)) for k, t in enumerate(titles)], "title string, url string")
    found = {r.title: r.tickers for r in etl.news_tag(items, etl.news_patterns(stocks)).collect()}
    assert found == {"une entreé ici": [], "Entre nous": ["ENTRE"], "xentre": [], "the M&M car": ["M&M"], "éM&M": [], "m&m": ["M&M"]}


def test_weights_of_other_members_fail(spark):
    aligned = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.3), ("b", 2, 0.1)], "ticker string, t int, ret double")
    for weights in ([("a", 1.0)], [("a", 0.5), ("b", 0.4)], [("a", 0.5), ("c", 0.5)]):
        with pytest.raises(Exception, match="weights"):
            portfolio.diversification_ratio(aligned, spark.createDataFrame(weights, "ticker string, weight double")).collect()


@pytest.mark.parametrize("method", optimizer.METHODS)
def test_allocations(method):
    returns, sectors = _universe(8, 300), np.array(list("aabbccdd"))
    k = optimizer.Constraints()
    cov, mu, sigma = _annual(returns)
    w = optimizer.allocate(method, cov, mu, sigma, sectors, k)
    assert w.sum() == pytest.approx(1) and (w >= 0).all()
    assert w.max() <= k.max_sector  # scaling to a sum of 1 comes last and can exceed the limit, as stated
    equal = np.full(8, 1 / 8)
    if method == "min_variance":
        assert w @ cov @ w <= equal @ cov @ equal
    if method in ("max_sharpe", "target_vol"):
        assert (w @ mu - 0.06) / np.sqrt(w @ cov @ w) >= (equal @ mu - 0.06) / np.sqrt(equal @ cov @ equal)
    few = optimizer.project(w, sectors, optimizer.Constraints(max_positions=4, max_sector=1.0))
    assert (few > 0).sum() <= 4


def test_frontier_and_small_portfolios(spark):
    rows = [("p", t, date(2020, 1, 1) + timedelta(days=d), float(x), "ab"[k % 2]) for k, t in enumerate("wxyz") for d, x in enumerate(_universe(4, 60)[k])]
    rows += [("one", "w", date(2020, 1, 1) + timedelta(days=d), 0.01 * (d % 3), "a") for d in range(30)]
    rows += [("short", t, date(2020, 1, 1) + timedelta(days=d), 0.01 * (d % 3), "a") for t in "xy" for d in range(5)]
    df = spark.createDataFrame(rows, "portfolio_id string, ticker string, date date, ret double, sector string")
    points = optimizer.efficient_frontier(df, optimizer.Constraints(max_weight=1.0, max_sector=1.0)).orderBy("portfolio_id", "point").collect()
    assert {p.portfolio_id for p in points} == {"p", "one"} - {"one"}
    vols = [p.volatility for p in points]
    assert vols == sorted(vols) and all(abs(sum(p.weights) - 1) < 1e-9 for p in points)
    weights = {(r.portfolio_id, r.ticker): r.weight for r in optimizer.optimise(df, "max_sharpe").collect()}
    assert weights["one", "w"] == 1 and weights["short", "x"] == weights["short", "y"] == 0.5


def test_drawdowns_histogram_and_dca(spark):
    curve = spark.createDataFrame([(date(2020, 1, 1 + k), v) for k, v in enumerate([100.0, 120.0, 120.0, 90.0, 100.0, 125.0, 110.0, 112.0])], "date date, equity double")
    found = [tuple(r) for r in portfolio.top_drawdowns(curve).collect()]
    assert found == [(date(2020, 1, 3), date(2020, 1, 4), date(2020, 1, 6), 0.25), (date(2020, 1, 6), date(2020, 1, 7), None, pytest.approx(0.12))]
    h = portfolio.histogram(curve.withColumn("ret", F.lit(1.0)), "ret", 30).collect()
    assert len(h) == 1 and h[0].n == 8
    assert sum(r.n for r in portfolio.histogram(curve, "equity", 4).collect()) == 8
    end = {f: portfolio.dca(flat(spark), 6000.0, f).orderBy(F.desc("date")).first() for f in ("weekly", "monthly")}
    assert all(r.invested == pytest.approx(6000) and r.value == pytest.approx(6000) for r in end.values())
    r = spark.range(1).select(portfolio.annualized_return(F.lit(121.0), F.lit(100.0), F.lit(504)), portfolio.annualized_return(F.lit(1.0), F.lit(0.0), F.lit(5))).first()
    assert r[0] == pytest.approx(0.1) and r[1] is None


def test_store(spark):
    at = lambda k: datetime(2024, 1, 1) + timedelta(days=k)
    row = lambda name, k, made=None: (name, ["A"], [1.0], "{}", at(made if made is not None else k), at(k))
    full = spark.createDataFrame([row(f"p{k:02d}", k) for k in range(20)], store.SCHEMA)
    names = lambda df: [r.name for r in store.listed(df).collect()]
    assert names(full)[0] == "p19"
    more = store.save(full, spark.createDataFrame([row("new", 50)], store.SCHEMA))
    assert len(names(more)) == 20 and "p00" not in names(more) and names(more)[0] == "new"
    again = store.load(store.save(full, spark.createDataFrame([row("p03", 60)], store.SCHEMA)), "p03").first()
    assert again.created_at == at(3) and again.updated_at == at(60)
    assert store.delete(full, "p03").count() == 19
    good = {"name": "x", "tickers": ["A"], "weights": [1], "strategy": "s", "createdAt": "2024-01-01T00:00:00Z", "updatedAt": "2024-01-02T00:00:00Z"}
    lines = spark.createDataFrame([("not json",), ("{}",), (json.dumps([good, {"name": ""}, {**good, "weights": []}]),)], "value string")
    assert [r.name for r in store.parse(lines).collect()] == ["x"]


def test_price_files(spark, tmp_path):
    good = {"ticker": "A", "dates": ["2020-01-02", "2020-01-03"], "open": [1, 2], "high": [2, 3], "low": [1, 1], "close": [2, 2.5], "volume": [10, 0]}
    (tmp_path / "A.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text("{broken")
    rows = bar_source.scan_prices_json(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.ticker, r.date, r.close) for r in rows] == [("A", date(2020, 1, 2), 2.0), ("A", date(2020, 1, 3), 2.5)]
    etl.write_bars(bar_source.scan_prices_json(spark, str(tmp_path / "A.json")), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    etl.write_csv(spark.createDataFrame([("a,b", 1)], "x string, y int"), ["x", "y"], str(tmp_path / "csv"))
    etl.write_json(spark.createDataFrame([("b",), ("a",)], "x string"), str(tmp_path / "json"), "x")
    assert "".join(f.read_text() for f in sorted((tmp_path / "csv").glob("part-*"))) == 'x,y\n"a,b",1\n'


def test_formats_of_missing_values(spark):
    x = F.lit(None).cast("double")
    row = spark.range(1).select(fmt.format_price(x), fmt.format_pct(x), fmt.format_sharpe(x), fmt.format_price_short(x), fmt.format_yr1_pct(F.lit(float("nan"))), fmt.fmt_rupees(x), fmt.relative_time(F.lit(None).cast("timestamp"), F.current_timestamp()), fmt.format_inr(F.lit(-12345678.0)), fmt.format_inr_full(F.lit(1234567.0))).first()
    assert list(row) == ["—", "—", "—", "--", "--", "—", "", "-₹1.23Cr", "₹12,34,567"]


def test_streams(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    ticks = [("A", at(m), 100.0 + m, 1.0) for m in range(0, 300, 10)]
    schema = "ticker string, ts timestamp, price double, volume double"
    spark.createDataFrame(ticks, schema).coalesce(1).write.parquet(str(tmp_path / "ticks"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "ticks"))
    out = stream.stream_bars(source, "1 hour", "0 minutes").writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    out.processAllAvailable()
    out.stop()
    bars = spark.table("bars_out").orderBy("start").collect()
    assert len(bars) >= 4 and (bars[0].open, bars[0].close, bars[0].high, bars[0].volume) == (100.0, 150.0, 150.0, 6.0)
    closes = [("A", at(m), float(m)) for m in range(6)]
    spark.createDataFrame(closes, "ticker string, start timestamp, close double").coalesce(1).write.parquet(str(tmp_path / "bars"))
    source = spark.readStream.schema("ticker string, start timestamp, close double").parquet(str(tmp_path / "bars"))
    out = stream.stream_ema(source, 3).writeStream.format("memory").queryName("ema_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    out.processAllAvailable()
    out.stop()
    got = [r.ema for r in spark.table("ema_out").orderBy("start").collect()]
    assert got[:2] == [None, None] and got[2:] == pytest.approx(recursive.ema(np.arange(6.0), 3)[2:].tolist())


def test_import_without_llm_and_without_a_session():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tidewright.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)


def test_registry_files(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and str(tmp_path / name)
    own = {"ticker": "A", "yf": "A.X", "name": "Alpha", "lot_size": 5, "sector": "consumer_discretionary"}
    stocks = registry.stocks(spark, put("r.json", {"stocks": [own, {**own, "ticker": "B", "sector": "it"}]}))
    assert {r.ticker: r.sector for r in stocks.collect()} == {"A": "consumer_disc", "B": "it"}
    assert [(r.sector, r.n) for r in etl.sector_counts(stocks, registry.SECTORS).collect()][1] == ("it", 1) and etl.search(stocks, "ALPH").count() == 2
    listed = registry.commodities(spark, put("c.json", {"commodities": [{"symbol": "G", "kind": "index"}, {"symbol": "B", "kind": "other"}]}))
    assert {r.ticker: r.instrument_class for r in registry.with_class(stocks.select("ticker"), listed).collect()} == {"A": "NSE_FO_STOCK", "B": "MCX_SINGLE"}
    values = registry.factor_file(spark, put("f.json", {"factors": {"A": {"pe": 1.5, "pb": None}}}))
    assert {(r.factor, r.value) for r in values.collect()} == {("pe", 1.5), ("pb", None)}
    summary = registry.summary_file(spark, put("s.json", {"stocks": {"A": {"close": 1.0, "yr1_pct": None, "date": "2024-01-02"}}, "mcx": {"G": {"close": 2.0, "yr1_pct": 0.1, "date": "2024-01-02"}}}))
    assert summary.count() == 2 and summary.where("ticker = 'G'").first().date == date(2024, 1, 2)
    assert registry.news_file(spark, put("n.json", {"items": [{"title": "t", "url": "u", "tickers": ["A"]}]})).first().tickers == ["A"]


def test_diversification_ratio_checks_its_weights(spark):
    aligned = spark.createDataFrame([(t, d, 0.01 * ((d * k) % 5)) for k, t in enumerate("xy", 1) for d in range(20)], "ticker string, t int, ret double")
    weights = lambda *w: spark.createDataFrame(list(zip("xyz", w)), "ticker string, weight double")
    assert portfolio.diversification_ratio(aligned, weights(0.5, 0.5)).first().ratio > 1
    assert portfolio.diversification_ratio(aligned.withColumn("ret", F.col("t") * 0.01), weights(0.4, 0.6)).first().ratio == pytest.approx(1)
    for bad in ((0.5, 0.6), (1.0,), (0.3, 0.3, 0.4)):
        with pytest.raises(Exception, match="weights"):
            portfolio.diversification_ratio(aligned, weights(*bad)).collect()

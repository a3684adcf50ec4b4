"""Stored bars: batches merged into folders, bucketed tables, price files, table functions; news tags by automaton; as-of levels; grouping sets."""

import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import factors
from tidewright.operators.indicators import indicator
from tidewright.operators.strategy import BackTest
from tidewright.plans.config import PRESETS
from tidewright.sources import bar_store, etl, table_functions
from tidewright.sources.bars import scan_prices_json

from .test_scan import series


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/month=*/*.parquet")}


def test_a_batch_rewrites_only_its_folders_and_can_be_repeated(spark, tmp_path):
    bars, path = series(spark, 120), str(tmp_path / "bars")
    bar_store.write_history(bars, path, buckets=3)
    before = files(path)
    last = bars.agg(F.max("date")).first()[0]
    batch = bars.where(F.col("date") > F.lit(last) - F.expr("interval 20 days")).withColumn("close", F.col("close") + 5)
    batch = batch.unionByName(batch.limit(1).withColumns({"ticker": F.lit("new")}))
    want = sorted(etl.upsert_by_date(bars, batch).collect())
    for _ in range(2):
        bar_store.merge_batch(batch, path, "one", buckets=3)
        assert sorted(bar_store.read_bars(spark, path).select(*bars.columns).collect()) == want
        assert not os.path.exists(f"{path}-staged/one")
    touched = {(r["bucket"], r["month"]) for r in bar_store._placed(batch, 3).select("bucket", "month").distinct().collect()}
    same = {f for f, t in before.items() if files(path).get(f) == t}
    folder = lambda f: (int(f.split("bucket=")[1].split("/")[0]), f.split("month=")[1].split("/")[0])
    assert same == {f for f in before if folder(f) not in touched} and len(same) > 0


def test_a_batch_stopped_while_it_replaced_folders_is_repeated_from_its_stage(spark, tmp_path, monkeypatch):
    bars, path = series(spark, 60), str(tmp_path / "bars")
    bar_store.write_history(bars, path, buckets=2)
    batch = bars.where("ticker = 'b'").withColumn("close", F.lit(1.0))
    whole = bar_store._write

    def stopped(placed, to):
        for f in files(to):
            os.remove(f)  # the worst case: folders are gone, none is replaced yet
        raise RuntimeError("stopped")

    monkeypatch.setattr(bar_store, "_write", stopped)
    with pytest.raises(RuntimeError):
        bar_store.merge_batch(batch, path, "one", buckets=2)
    monkeypatch.setattr(bar_store, "_write", whole)
    bar_store.merge_batch(batch, path, "one", buckets=2)
    stored = bar_store.read_bars(spark, path).where("ticker = 'b'").select(*bars.columns)
    assert sorted(stored.collect()) == sorted(batch.collect())


def test_append_keeps_what_is_stored(spark, tmp_path):
    bars, path = series(spark, 40), str(tmp_path / "bars")
    bar_store.write_history(bars.where("date < '2000-03-01'"), path, buckets=2)
    bar_store.merge_batch(bars.withColumn("close", F.lit(0.0)), path, "one", "append", buckets=2)
    got = bar_store.read_bars(spark, path)
    assert got.count() == bars.count() and got.where("close = 0 and date < '2000-03-01'").count() == 0


def test_back_tests_over_a_bucketed_table_have_no_exchange(spark, tmp_path):
    bars = series(spark, 300).withColumns({"lot_size": F.lit(50), "instrument_class": F.lit("NSE_FO_STOCK")})
    table = bar_store.write_bucketed(bars, "bucketed_bars", str(tmp_path / "t"), buckets=3)
    for name in ("bollinger_bounce", "momentum_6m"):
        metrics = BackTest(table, PRESETS[name]).metrics
        plan = metrics._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert sorted(metrics.collect()) == sorted(BackTest(bars, PRESETS[name]).metrics.collect())
    spark.sql("DROP TABLE bucketed_bars")


def test_price_files_are_read_back(spark, tmp_path):
    bars = series(spark, 30)
    etl.write_price_files(bars, str(tmp_path / "p"))
    assert sorted(scan_prices_json(spark, str(tmp_path / "p")).select(*bars.columns).collect()) == sorted(bars.collect())


@pytest.mark.parametrize("key", ["macd", "keltner"])
def test_table_functions_equal_the_indicators(spark, key):
    table_functions.register_functions(spark)
    bars = series(spark, 80)
    got = spark.sql(f"SELECT * FROM {key}(TABLE({{bars}}) PARTITION BY ticker ORDER BY date)", bars=bars)
    assert sorted(got.collect(), key=str) == sorted(indicator(bars, key).collect(), key=str)


def test_news_tags_by_automaton_equal_those_by_join(spark):
    r = random.Random(5)
    parts = ["tata", "Tata", "tatas", "m&m", "M&M", "steel", "Éclair", "éclair", "日本", "日本語", "co_", "a1", "x"]
    titles = [(k, "".join(r.choice(parts) + r.choice([" ", "-", "", ".", "_", "é "]) for _ in range(r.randrange(12)))) for k in range(300)]
    items = spark.createDataFrame([*titles, (900, None), (901, "")], "arrival long, title string").withColumn("url", F.col("arrival").cast("string"))
    patterns = spark.createDataFrame([("T", "tata"), ("M", "m&m"), ("S", "steel"), ("E", "éclair"), ("J", "日本"), ("T2", "tata"), ("A", "a1"), ("Z", "")], "ticker string, token string")
    got = {r["arrival"]: r["tickers"] for r in etl.news_tag(items, patterns).collect()}
    want = {r["arrival"]: r["tickers"] for r in etl.news_tag_by_join(items, patterns.where("token <> ''")).collect()}
    assert got == want and any(len(x) > 1 for x in got.values())
    plan = etl.news_tag(items, patterns)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan
    assert etl.news_tag(items, patterns.limit(0)).where("size(tickers) > 0").count() == 0


def test_as_of_levels_equal_a_plain_search(spark):
    r = random.Random(2)
    day = lambda k: datetime.date(1999, 11, 1) + datetime.timedelta(days=k)
    left = [(t, day(r.randrange(900))) for t in "abc" for _ in range(60)]
    right = [(day(k), float(k) if k % 3 else None) for k in sorted(r.sample(range(100, 800), 40))]
    got = factors.asof_market(spark.createDataFrame(left, "ticker string, date date"), spark.createDataFrame(right, "date date, level double"))
    want = [(t, d, next((x for e, x in reversed(right) if e <= d and x is not None), None)) for t, d in left]
    assert sorted(map(tuple, got.select("ticker", "date", "market").collect()), key=str) == sorted(want, key=str)


def test_totals_hold_the_monthly_and_yearly_sums_in_one_pass(spark):
    bars = series(spark, 300).withColumns({"lot_size": F.lit(50), "instrument_class": F.lit("NSE_FO_STOCK")})
    run = BackTest(bars, PRESETS["golden_cross"])
    totals = run.totals
    assert sorted(totals.where("level = 0").select("ticker", "year", "month", "pnl").collect()) == sorted(run.monthly.collect())
    assert sorted(totals.where("level = 1").select("ticker", "year", "pnl").collect()) == sorted(run.yearly.collect())
    assert totals.where("level = 3").count() == 2

import re

from tidewright.operators import factors
from tidewright.sources import bars as fixtures


def test_price_factors_deal_out_and_sort_bars_once(spark):
    """From the order lines to a row a ticker, lines go through one shuffle by ticker and one sort by (ticker, date)."""
    bars = fixtures.bars_supplier(spark, "/root/testdata/sf0.001")
    proxy = spark.createDataFrame([], "date date, level double")
    plan = factors.price_factors(bars, proxy)._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(shuffles) == 1 and re.match(r"ticker#\d+, \d+$", shuffles[0])
    assert len(re.findall(r"\bSort \[", plan)) == 1 and "DESC" not in plan

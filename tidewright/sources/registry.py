"""Instrument and commodity lists from registry files, and the saved factor, summary and news files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.costs import instrument_class

#: Sectors in their order, and names that registry files use for them.
SECTORS = ("financials", "it", "energy", "materials", "healthcare", "consumer_disc", "consumer_staples", "industrials")
SECTOR_NAMES = {"consumer_discretionary": "consumer_disc"}


def stocks(spark: SparkSession, path: str) -> DataFrame:
    """ticker, yf, name, lot_size, sector of a registry file."""
    files = spark.read.schema("stocks array<struct<ticker: string, yf: string, name: string, lot_size: int, sector: string>>").json(path, multiLine=True)
    rows = files.select(F.explode("stocks").alias("s")).select("s.*")
    renamed = F.create_map(*[F.lit(x) for kv in SECTOR_NAMES.items() for x in kv])
    return rows.withColumn("sector", F.coalesce(renamed[F.col("sector")], "sector"))


def commodities(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ..., kind of a commodity registry file; a kind other than index is single."""
    record = "symbol: string, mcx_ticker: string, bbg_ticker: string, name: string, kind: string, contract_size: string, tick_size: double, lot_size: int"
    files = spark.read.schema(f"commodities array<struct<{record}>>").json(path, multiLine=True)
    return files.select(F.explode("commodities").alias("c")).select("c.*").withColumn("kind", F.when(F.col("kind") == "index", "index").otherwise("single"))


def with_class(tickers: DataFrame, commodity_list: DataFrame) -> DataFrame:
    """tickers with instrument_class: equities are those that the commodity list lacks."""
    kinds = commodity_list.select(F.col("symbol").alias("ticker"), F.col("kind").alias("_kind"))
    return tickers.join(kinds, "ticker", "left").withColumn("instrument_class", instrument_class(F.col("ticker"), F.col("_kind"))).drop("_kind")


def factor_file(spark: SparkSession, path: str) -> DataFrame:
    """ticker, factor, value of a saved factor file."""
    files = spark.read.schema("computed_at string, universe_size int, factors map<string, map<string, double>>").json(path, multiLine=True)
    return files.select(F.explode("factors").alias("ticker", "own")).select("ticker", F.explode("own").alias("factor", "value"))


def summary_file(spark: SparkSession, path: str) -> DataFrame:
    """ticker, close, yr1_pct, date of a saved price summary, stocks and commodities together."""
    one = "map<string, struct<close: double, yr1_pct: double, date: string>>"
    files = spark.read.schema(f"generated_at string, stocks {one}, mcx {one}").json(path, multiLine=True)
    both = files.select(F.explode("stocks").alias("ticker", "s")).unionByName(files.select(F.explode("mcx").alias("ticker", "s")))
    return both.select("ticker", "s.close", "s.yr1_pct", F.to_date("s.date").alias("date"))


def news_file(spark: SparkSession, path: str) -> DataFrame:
    """title, url, source, published, tickers of a saved news file."""
    files = spark.read.schema("updated_at string, items array<struct<title: string, url: string, source: string, published: timestamp, tickers: array<string>>>").json(path, multiLine=True)
    return files.select(F.explode("items").alias("i")).select("i.*")

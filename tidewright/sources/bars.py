"""Daily bars (ticker, date, open, high, low, close, volume) from price files or from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _bars(ticks: DataFrame) -> DataFrame:
    """ticks: ticker, l_shipdate, l_orderkey, l_linenumber, px, l_quantity. Open and close by the smallest and largest (order, line, price)."""
    at = F.struct("l_orderkey", "l_linenumber", "px")
    return ticks.groupBy("ticker", F.col("l_shipdate").cast("date").alias("date")).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.sum("l_quantity").alias("volume")
    )


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades, at a hundredth of the unit price over a base, which keeps compounded returns finite."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", (1000 + F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("px"))


def bars_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker a part type: few, dense series."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("ticker"))
    return _bars(_ticks(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey")))


def bars_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker a supplier: many, sparse series.

    Most (ticker, date) have one order line, so that nothing is gained by aggregating before the shuffle; lines
    are dealt out by ticker, and what follows by ticker needs no shuffle of its own.
    """
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("ticker"))
    return _bars(_ticks(spark, sf_dir).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).repartition("ticker"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector, lot_size, instrument_class of each supplier."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    joined = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.element_at(F.array(F.lit("NSE_FO_STOCK"), F.lit("MCX_SINGLE"), F.lit("MCX_INDEX")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return joined.select(F.col("s_name").alias("ticker"), F.col("r_name").alias("sector"), (25 * (1 + F.col("s_suppkey") % 8)).cast("int").alias("lot_size"), kind.alias("instrument_class"))


PRICE_FILE = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("dates", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("open", "high", "low", "close", "volume")]
    + [T.StructField("_corrupt_record", T.StringType())]
)


def scan_prices_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars of all price files under a path or glob: one JSON object a ticker, with aligned arrays. Unreadable files give no rows; a file without a ticker has its own name's stem."""
    files = spark.read.schema(PRICE_FILE).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    stem = F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.[^.]*$", "")
    good = files.where(F.col("_corrupt_record").isNull())
    rows = good.select(F.coalesce(F.when(F.col("ticker") != "", F.col("ticker")), stem).alias("ticker"), F.explode(F.arrays_zip("dates", "open", "high", "low", "close", "volume")).alias("r"))
    return rows.select("ticker", F.to_date("r.dates").alias("date"), *[F.col(f"r.{c}").alias(c) for c in COLUMNS[2:]])


def preload(spark: SparkSession, path: str, name: str = "prices") -> DataFrame:
    """The bars of price files as a temporary view that Spark keeps in memory, and on disk beyond it."""
    scan_prices_json(spark, path).createOrReplaceTempView(name)
    spark.catalog.cacheTable(name)
    return spark.table(name)


def is_preloaded(spark: SparkSession, name: str = "prices") -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.isCached(name)


def clear(spark: SparkSession, name: str = "prices") -> None:
    """Forgets the view and what is kept of it; a name that is not known changes nothing."""
    if spark.catalog.tableExists(name):
        spark.catalog.uncacheTable(name)
        spark.catalog.dropTempView(name)

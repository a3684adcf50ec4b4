"""Stored bars: a table in folders by ticker bucket and month that batches are merged into, and bucketed tables that need no exchange."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .etl import append_new, upsert_by_date

c = F.col
FOLDERS = ["bucket", "month"]
MERGES = {"upsert": upsert_by_date, "append": append_new}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors see; a local one only where that is unset and the master is local."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder := tempfile.mkdtemp(prefix="checkpoint-"))
    return folder


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _placed(bars: DataFrame, buckets: int) -> DataFrame:
    return bars.withColumns({"bucket": F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int"), "month": F.date_format("date", "yyyy-MM")})


def _write(placed: DataFrame, path: str) -> None:
    """Replaces the folders that the rows belong to, one file a folder; others are not touched."""
    dealt = placed.repartition(*FOLDERS).sortWithinPartitions("ticker", "date")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(*FOLDERS)


def write_history(bars: DataFrame, path: str, buckets: int = 64) -> None:
    """Bars as a new stored table."""
    _write(_placed(bars, buckets), path)


def merge_batch(batch: DataFrame, path: str, batch_id: str, how: str = "upsert", buckets: int = 64) -> None:
    """Merges a batch into the stored table: of each (ticker, date) the batch's row ("upsert"), or the stored one if there is one ("append").

    Only folders that the batch has rows of are read and rewritten. Their merged rows are staged in whole next to
    the table first, under the batch's id; a run that was stopped while it replaced folders is repeated from
    there, and one that was stopped before from the table, so repeating a batch changes nothing.
    """
    spark = batch.sparkSession
    staged = f"{path}-staged/{batch_id}"
    if not _exists(spark, f"{staged}/_SUCCESS"):
        new = _placed(batch, buckets)
        touched = new.select(*FOLDERS).distinct()
        stored = spark.read.parquet(path).withColumns({"bucket": c("bucket").cast("int"), "month": c("month").cast("string")})
        before = stored.join(touched, FOLDERS, "left_semi").drop(*FOLDERS).select(*batch.columns)  # prunes folders while it runs
        merged = MERGES[how](before, batch)
        _placed(merged, buckets).write.mode("overwrite").parquet(staged)
    _write(spark.read.parquet(staged), path)
    _delete(spark, staged)


def write_bucketed(bars: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """bars as a table bucketed by ticker and sorted by (ticker, date), one file a bucket: windows, groups and joins by ticker need no exchange."""
    bars.repartition(buckets, "ticker").write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "ticker").sortBy("ticker", "date").saveAsTable(table)
    return bars.sparkSession.table(table)

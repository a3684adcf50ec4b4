"""Saved portfolios as a table of versions: name, tickers, weights, strategy (JSON), created_at, updated_at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col
MOST = 20
SCHEMA = "name string, tickers array<string>, weights array<double>, strategy string, created_at timestamp, updated_at timestamp"


def parse(lines: DataFrame) -> DataFrame:
    """Portfolios of JSON text (column value, an array of records); what does not parse or lacks a field is skipped."""
    record = "struct<name: string, tickers: array<string>, weights: array<double>, strategy: string, createdAt: timestamp, updatedAt: timestamp>"
    rows = lines.select(F.explode(F.from_json("value", f"array<{record}>")).alias("p")).select("p.*").withColumnsRenamed({"createdAt": "created_at", "updatedAt": "updated_at"})
    whole = (F.length("name") > 0) & c("updated_at").isNotNull() & c("created_at").isNotNull() & (F.size("tickers") == F.size("weights"))
    return rows.where(whole)


def save(store: DataFrame, new: DataFrame, most: int = MOST) -> DataFrame:
    """store with new portfolios: one of a known name replaces it and keeps its created_at; the oldest updated go when a new name makes them more than most. One user's portfolios are few, so their windows are one task's work."""
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    named = Window.partitionBy("name")
    one = both.withColumns({"created_at": F.min("created_at").over(named), "_fresh": F.min("_new").over(named) == 1}).withColumn("_n", F.row_number().over(named.orderBy(F.desc("_new"), F.desc("updated_at")))).where("_n = 1").drop("_n")
    kept = one.withColumns({"_any": F.max(c("_fresh").cast("int")).over(Window.partitionBy(F.lit(0))), "_rank": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("updated_at"), F.desc("_new"), "name"))})
    return kept.where((c("_any") == 0) | (c("_rank") <= most)).select(*store.columns)


def listed(store: DataFrame) -> DataFrame:
    return store.orderBy(F.desc("updated_at"), "name")


def load(store: DataFrame, name: str) -> DataFrame:
    return store.where(c("name") == name)


def delete(store: DataFrame, name: str) -> DataFrame:
    return store.where(c("name") != name)

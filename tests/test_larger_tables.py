"""What fails only on larger tables: large keys and long batches, made small."""

from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from tidewright.functions import fmt
from tidewright.queries import ORACLES, QUERIES
from tidewright.sources import etl


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con


def test_ages_beyond_all_timestamps(spark, tmp_path):
    con = documents(spark, tmp_path, [(k, "t", "s1") for k in (None, 0, 1, 9, 500, 392_111, 392_112, 1_000_000, 30_000_000)])
    got = QUERIES["relative_time"](spark, str(tmp_path)).select("arrival", "age").collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(f"SELECT arrival, age FROM ({ORACLES['relative_time']})").fetchall(), key=str)


def test_ages_of_timestamps_are_those_of_their_seconds(spark):
    now = datetime(2024, 5, 1)
    ages = [-5, 0, 59, 60, 89, 90, 3569, 3570, 84_599, 84_600, 600_000, 2_800_000, 3_000_000, 40_000_000]
    rows = spark.createDataFrame([(a, now - timedelta(seconds=a), now) for a in ages], "age long, then timestamp, now timestamp")
    assert all(a == b for a, b in rows.select(fmt.relative_time(F.col("then"), F.col("now")), fmt.relative_age(F.col("age"))).collect())


def test_news_tags_walk_texts_in_short_batches(spark):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "10000")
    try:
        items = spark.range(3000).selectExpr("id as arrival", "concat('news of tata ', id) as title", "cast(id as string) as url")
        tagged = etl.news_tag(items, spark.createDataFrame([("T", "tata")], "ticker string, token string"))
        assert int(spark.conf.get(rows)) <= 1000 and tagged.where("array_contains(tickers, 'T')").count() == 3000
    finally:
        spark.conf.set(rows, before)

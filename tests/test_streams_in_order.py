"""Recursive indicators over streams whose bars come late and out of order, against the batch indicator."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidewright.operators import recursive
from tidewright.streaming import bars as stream

SCHEMA = "ticker string, start timestamp, close double"
BEGAN = datetime(2024, 1, 1)


def minute(m):
    return BEGAN + timedelta(minutes=m)


def streamed(spark, folder, batches, **options):
    """The rows of the stream after the batches, each a file of its own, read once by availableNow per file."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for batch in batches:
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
            query = stream.stream_ema_in_order(source, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.parquet(f"{folder}/out").collect()


def test_shuffled_bars_equal_the_batch_indicator(spark, tmp_path):
    r = random.Random(2)
    series = {t: {m: float(r.randint(90, 110)) for m in range(60)} for t in "AB"}
    came = sorted(((m + r.uniform(0, 8), t, m) for t in series for m in series[t]))  # up to 8 minutes late
    rows = [(t, minute(m), series[t][m]) for _, t, m in came]
    batches = [rows[k : k + 40] for k in range(0, len(rows), 40)]
    batches[1] = [*batches[1], batches[1][-1]]  # a repeated bar
    batches.append([(t, minute(1000), 1.0) for t in series])  # moves the watermark past all
    batches.append([("A", minute(5), 1e9), ("A", minute(1001), 1.0)])  # far too late: dropped
    got = streamed(spark, tmp_path, batches, period=5, late="10 minutes")
    for t in series:
        want = recursive.ema(np.array([series[t][m] for m in range(60)]), 5)
        own = {x.start: x.ema for x in got if x.ticker == t}
        values = [own[minute(m)] for m in range(60)]
        assert values[:4] == [None] * 4 and values[4:] == pytest.approx(want[4:].tolist())
    assert len(got) == len({(x.ticker, x.start) for x in got})


def test_idle_series_begin_anew(spark, tmp_path):
    first = [("A", minute(m), 10.0) for m in range(4)]
    batches = [first, [("B", minute(500), 1.0)], [("B", minute(501), 1.0)], [("A", minute(502 + m), 20.0) for m in range(3)], [("B", minute(900), 1.0)]]
    got = {x.start: x.ema for x in streamed(spark, tmp_path, batches, period=2, late="1 minute", idle_ms=60 * 60 * 1000) if x.ticker == "A"}
    assert [got[minute(m)] for m in range(4)] == [None, 10.0, 10.0, 10.0]
    assert [got[minute(502 + m)] for m in range(3)] == [None, 20.0, 20.0]

"""The mix as rows: words of each source near its target, whatever the doc_ids are."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.llm import mixing

from .fixtures import DOC, docs, no_docs, prose


def weight(k):
    return (3, 1, 2)[k % 3]


@pytest.mark.parametrize("ids", ["own", "half null", "three", "all null"])
def test_sources_meet_their_targets_on_null_and_repeated_ids(spark, ids):
    key = {"own": lambda k: k, "half null": lambda k: k if k % 2 else None, "three": lambda k: k % 3, "all null": lambda k: None}[ids]
    rows = [(key(k), prose(k, 20 + k % 40), "en", ("a", "b", None)[k % 7 % 3], 1, "x", "x", "x", "x", "x") for k in range(600)]
    table = spark.createDataFrame(rows, DOC)
    aims = {r["source"]: r["target"] for r in mixing.mix(table, weight).select("source", "target").distinct().collect()}
    out = mixing.apply_mix(table, weight)
    assert out.columns == table.columns
    got, times = Counter(), Counter()
    for r in out.collect():
        got[r["source"]] += len(r["text"].split())
        times[r["text"]] += 1
    assert all(abs(got[s] - t) <= 0.01 * t for s, t in aims.items()) and max(times.values()) <= 2
    assert sorted(out.collect(), key=str) == sorted(mixing.apply_mix(table.repartition(5), weight).collect(), key=str)


def test_large_sizes_take_a_share_of_all_hashes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EXACT", 3)
    rows = [(None, " ".join(f"w{k}x{i}" for i in range(10)), "en", ("a", "b")[k % 3 > 0], 1, "x", "x", "x", "x", "x") for k in range(3000)]
    table = spark.createDataFrame(rows, DOC)
    aims = {r["source"]: r["target"] for r in mixing.mix(table, weight).select("source", "target").distinct().collect()}
    got = {r["source"]: 10 * r["n"] for r in mixing.apply_mix(table, weight).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got[s] - t) <= 0.05 * t for s, t in aims.items())


def test_odd_rows_keep_their_columns(spark):
    out = mixing.apply_mix(docs(spark), weight)
    assert out.columns == docs(spark).columns and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs(spark).collect()}
    assert mixing.apply_mix(no_docs(spark), weight).count() == 0

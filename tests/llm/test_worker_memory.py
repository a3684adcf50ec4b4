import pyarrow as pa
from pyspark.sql import functions as F

from tidewright.functions.batches import text_slices
from tidewright.llm import mixing, packing
from tidewright.llm.queries import tokenizer_file


def test_slices_are_bounded_by_bytes_and_rows():
    texts = ["a" * 10, None, "", "b" * 300, "c" * 40, *["d"] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = list(text_slices(batch, 1, most_bytes=50, most_rows=6))
    assert [s.num_rows for s in found] == [4, 6, 4]
    assert [t for s in found for t in s.column(1).to_pylist()] == texts
    assert not list(text_slices(batch.slice(0, 0), 1))


def test_few_remembered_words_give_the_same_ids():
    texts = [" ".join(f"word{k * i % 97}." for k in range(40)).encode() for i in range(60)]
    few, many = (packing.WordTokenizer(tokenizer_file(), n) for n in (20, 10_000))
    at = [texts[k : k + 5] for k in range(0, 60, 5)]
    assert [x for part in at for x in few.encode(part)] == [x for part in at for x in many.encode(part)]
    assert len(few.known) < len(many.known)


def test_mixing_starts_no_workers_for_its_small_tables(spark):
    """Rows handed to createDataFrame as a list go through Python workers of their own; Arrow tables do not."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    thin = docs.select("source", mixing.words("text").alias("size"))
    numbers, _ = mixing._solved(spark, thin, lambda k: [3, 1, 2][k % 3], 1.5)
    assert "LocalTableScan" in numbers._jdf.queryExecution().executedPlan().toString()
    assert [r["source"] for r in numbers.orderBy("number").collect()] == ["s1", "s2", None]

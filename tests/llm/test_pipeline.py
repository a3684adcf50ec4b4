import corpus_pipeline

from .fixtures import docs, prose


def test_stages(spark, tmp_path):
    made = docs(spark).where("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(100 + k, prose(500 + k, 80), "en", f"s{k % 3}", 1) for k in range(60)], made.schema)
    made.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == made.columns
        out.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "language_id":
            assert not {20, 21, 22} & {r.doc_id for r in left.collect()} and left.count() >= 75
        if name == "exact_dedup":
            ids = [r.doc_id for r in left.collect()]
            assert 23 not in ids and 24 not in ids and len(ids) == len(set(ids)) and set(range(100, 160)) <= set(ids)
        df = left
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() >= df.count() and set(packed.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}

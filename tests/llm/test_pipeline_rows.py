"""The pipeline and its stages on empty tables, rows without a doc_id, repeated rows and clashing columns."""

import corpus_pipeline

from .fixtures import DOC, docs, prose

CLASHING = "id long, text_key long, node long, token long, component long, row long, label long, copies long, rank long"


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_rows_without_a_doc_id_and_clashing_columns(spark, tmp_path):
    more = [c.split()[0] for c in CLASHING.split(", ")]
    texts = {k: prose(700 + k, 70) for k in range(30)}
    rows = [(k, t, "en", f"s{k % 2}", 1, "x", "x", "x", "x", "x") for k, t in texts.items()]
    rows += [(None, prose(900 + k, 70), "en", None, 1, "x", "x", "x", "x", "x") for k in range(6)] + [(None, texts[3], "en", "s1", 1, "x", "x", "x", "x", "x")] * 2
    rows += [(3, texts[3], "en", "s1", 1, "y", "x", "x", "x", "x"), (50, texts[4] + " tail", "en", "s0", 1, "x", "x", "x", "x", "x")]
    made = spark.createDataFrame(rows, DOC)
    for name in more:
        made = made.selectExpr("*", f"cast(7 as long) as {name}")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.distinct_texts(spark, df, "").columns == made.columns
    kept = corpus_pipeline.distinct_texts(spark, df, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["None"] * 6 + [str(k) for k in range(30)] + ["50"])
    assert [r.score for r in kept if r.doc_id == 3] == [r.score for r in corpus_pipeline.distinct_texts(spark, df.repartition(5), "").collect() if r.doc_id == 3]
    near = corpus_pipeline.no_near_copies(spark, df, "")
    assert near.columns == made.columns
    assert sorted(str(r.doc_id) for r in near.collect()) == sorted(["None"] * 6 + [str(k) for k in range(30)])
    mixed = corpus_pipeline.mixed_sources(spark, df, "")
    assert mixed.columns == made.columns and mixed.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).where("doc_id is null").count() > 0


def test_known_language_keeps_columns(spark):
    out = corpus_pipeline.known_language(spark, docs(spark), "")
    assert out.columns == docs(spark).columns

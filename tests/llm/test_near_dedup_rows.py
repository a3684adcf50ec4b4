from tidewright.llm import simhash

from .fixtures import prose


def test_rows_without_or_of_one_doc_id(spark):
    a, b, c, d = (prose(k, 80) for k in range(4))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (7, d), (7, prose(9, 80)), (7, d), (8, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([("None", a), ("None", b), ("1", c), ("7", d), ("7", prose(9, 80))])
    assert sorted((str(r.doc_id), r.text) for r in simhash.near_dedup(df).collect()) == want

"""Toxicity by compression distance: parts against plain loops, planted toxic words found in held-back texts."""

import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tidewright.llm import toxicity, words

from .fixtures import docs, no_docs, prose

FOUL = "wretched vermin dunderhead".split()


def made(seed, n, foul):
    r = random.Random(seed)
    out = []
    for k in range(n):
        ws = [*prose(seed + k, 60).split(), *(w[: r.randrange(3, 9)] + str(r.randrange(99)) for w in prose(k, 9).split())]
        for _ in range(foul):
            ws.insert(r.randrange(len(ws)), r.choice(FOUL).capitalize())
        out.append(" ".join(ws))
    return out


def rows():
    return [(1, t.encode()) for t in made(10_000, 60, 3)] + [(0, t.encode()) for t in made(20_000, 180, 0)]


def test_planted_words_are_found_and_clean_texts_left_alone(spark):
    model = toxicity.learn(rows())
    new = [(k, t) for k, t in enumerate(made(30_000, 30, 3) + made(40_000, 60, 0))]
    got = toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
    found = [r["predicted"] for r in sorted(got)]
    assert sum(found[:30]) >= 28 and sum(found[30:]) <= 1 and all(0 <= r["score"] <= 1 for r in got)


def test_the_order_of_rows_does_not_count():
    a, b = toxicity.learn(rows()), toxicity.learn(rows()[::-1])
    assert a.toxic == b.toxic and a.ordinary == b.ordinary and np.array_equal(a.weights, b.weights)


def test_distances_equal_single_compressions():
    toxic, ordinary = b" vermin  wretched  dunderhead ", b" river  mountain  garden "
    found = [b" vermin ", b" river ", b" dunderheads ", b" zzz ", b" "]
    by = [toxicity.compressor(x) for x in (toxic, ordinary)]
    single = [[len(c.compress(w + toxicity.PADDING)) for w in found] for c in by]
    assert [toxicity.lengths(c, found).tolist() for c in by] == single
    kinds = toxicity.hit_kinds(*by, found)
    want = [[(o - t >= s) and (o - t) / len(w) >= p for s in toxicity.STEPS for p in toxicity.SHARES] for w, t, o in zip(found, *single)]
    assert kinds.tolist() == want and kinds[0].any() and not kinds[1].any() and not kinds[3].any()


def test_counts_do_not_depend_on_batches_slices_or_memory(monkeypatch):
    toxic, ordinary = b" vermin  wretched  dunderhead ", b" river  mountain  garden "
    texts = [t.encode() for t in made(1, 5, 2)] + [b"", b"x" * 300]
    whole = toxicity.Counter(toxic, ordinary).counts(texts)
    assert whole[:5, -1].tolist() == [len(t.split()) for t in texts[:5]] and whole[5, -1] == 0 and whole[6, -1] == 5
    monkeypatch.setattr(toxicity, "REMEMBERED", 7)
    monkeypatch.setattr(toxicity, "AT_ONCE", 3)
    monkeypatch.setattr(words, "SLICE", 50)
    assert np.array_equal(toxicity.Counter(toxic, ordinary).counts(texts), whole)


def test_grams_and_their_contrast_equal_plain_sets():
    text = b"Vermin of rivers\nof"
    want = {w[i : i + 6] for w in (b" vermin ", b" of ", b" rivers ") for i in range(len(w) - 5)}
    assert set(toxicity._grams(text).tolist()) == {int.from_bytes(g, "big") for g in want}
    often, seldom = np.array([5]), np.array([9])
    assert toxicity.contrasted([often] * 40, [seldom] * 400).tolist() == [5]
    assert toxicity.contrasted([often] * 40, [often] * 400).tolist() == []


def test_calibration_has_no_slope_left():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 3))
    y = (x[:, 0] + r.normal(size=200) > 0).astype(float)
    mean, spread, w = toxicity.calibrate(x, y)
    z = np.c_[(x - mean) / spread, np.ones(200)]
    slope = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.array([*[toxicity.RIDGE] * 3, 1e-3]) * w
    assert np.abs(slope).max() < 1e-8


def test_too_few_labels_and_odd_rows(spark):
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark), marks)
    got = toxicity.score(docs(spark), model)
    assert got.count() == docs(spark).count() and got.where("score <> 0 or predicted <> 0").count() == 0
    assert toxicity.score(no_docs(spark), model).count() == 0
    scored = toxicity.score(docs(spark).withColumn("predicted", F.lit("x")), toxicity.learn(rows()))
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    assert scored.where("coalesce(text, '') = ''").select("score").distinct().count() == 1


def test_a_dictionary_of_too_few_samples_is_their_bytes():
    assert toxicity.trained([b" b ", b" a ", b" a "], 100) == b" a  b " and toxicity.trained([], 10) == b""
    assert isinstance(toxicity.compressor(b""), zstandard.ZstdCompressor)

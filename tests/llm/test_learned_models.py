"""The learned operators against plain loops, a known mixture and held-out rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import language_id, quality, queries
from tidewright.llm.subword import prepared, text_features

from .fixtures import prose

SMALL = "/root/testdata/sf0.001"


def test_risk_slopes_equal_finite_differences():
    r = random.Random(1)
    for shift, prior in ((0.0, 0.3), (-3.0, 0.9), (3.0, 0.5), (0.0, None)):
        z = [r.gauss(0, 1) + (shift if k < 6 else 0) for k in range(16)]
        positive = [k < 6 for k in range(16)]
        plus, minus = (lambda x: math.log1p(math.exp(-x))), (lambda x: math.log1p(math.exp(x)))

        def risks(z):
            pos = [x for x, p in zip(z, positive) if p]
            unl = [x for x, p in zip(z, positive) if not p]
            if prior is None:
                return sum(map(plus, pos)) / 6 + sum(map(minus, unl)) / 10, 1.0
            return prior * sum(map(plus, pos)) / 6, sum(map(minus, unl)) / 10 - prior * sum(map(minus, pos)) / 6

        got = quality.risk_slopes(np.array(z), np.array(positive), prior)
        for k in range(16):
            up, down = ([*z[:k], z[k] + d, *z[k + 1 :]] for d in (1e-5, -1e-5))
            (a, b), (c, d) = risks(up), risks(down)
            negatives = risks(z)[1]
            want = (a - c) / 2e-5 if prior is None else (-(b - d) / 2e-5 if negatives < 0 else (a + b - c - d) / 2e-5)
            assert got[k] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_the_prior_is_estimated_from_positives_and_unlabelled_text(share):
    good = [text_features(prepared(prose(k, 40).encode(), False), quality.ORDERS) for k in range(2400)]
    bad = [text_features(prepared(prose(9000 + k, 40).upper().encode(), False), quality.ORDERS) for k in range(1200)]
    n_good = int(1200 * share)
    rows = good[:1200] + good[1200 : 1200 + n_good] + bad[: 1200 - n_good]
    order = np.random.default_rng(1).permutation(2400)
    found = quality.estimate_prior([rows[k] for k in order], (np.arange(2400) < 1200)[order])
    assert abs(found - share) <= 0.1


def test_language_training_equals_a_plain_loop():
    rows = [(k % 2, *text_features(prepared((prose(k, 5) if k % 2 else prose(k, 5).upper()).encode(), False), language_id.ORDERS)) for k in range(6)]
    got = language_id.train(rows, 2, seed=3)
    rng = np.random.default_rng(3)
    width = language_id.WIDTH
    soft = rng.normal(0, width**-0.5, (width, 2)).astype(np.float32).tolist()
    embed = {}
    steps = language_id.EPOCHS * len(rows)
    for step, k in enumerate(np.concatenate([rng.permutation(len(rows)) for _ in range(language_id.EPOCHS)])):
        y, buckets, shares = rows[k]
        rate = language_id.RATE * (1 - step / steps)
        mean = [sum(float(s) * embed.get(b, [0.0] * width)[i] for b, s in zip(buckets, shares)) for i in range(width)]
        z = [sum(mean[i] * soft[i][c] for i in range(width)) for c in range(2)]
        p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
        p[y] -= 1
        back = [sum(soft[i][c] * p[c] for c in range(2)) for i in range(width)]
        for i in range(width):
            for c in range(2):
                soft[i][c] -= 0.2 * rate * mean[i] * p[c]
        for b, s in zip(buckets, shares):
            own = embed.setdefault(b, [0.0] * width)
            for i in range(width):
                own[i] -= 50 * rate * float(s) * back[i]
    for b, own in embed.items():
        want = [sum(own[i] * soft[i][c] for i in range(width)) for c in range(2)]
        assert got[b] == pytest.approx(want, abs=2e-3)


def test_held_out_language(spark):
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    found = queries.op9_language_id(spark, SMALL).join(truth, "doc_id").where("held_out and truth is not null and lang_pred <> 'und'").toPandas()
    assert len(found) >= 30 and (found.lang_pred == found.truth).mean() >= 0.97
    assert (found.score[found.lang_pred == found.truth]).mean() > 0.9


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    found = queries.op7_quality_classifier(spark, sf).join(marks, "doc_id").where("held_out").toPandas()
    good, bad = found.score[found.quality == 1].to_numpy(), found.score[found.quality == 0].to_numpy()
    assert len(good) >= 20 and len(bad) >= 5
    assert (good[:, None] > bad[None, :]).mean() >= 0.97 and (found.predicted == found.quality).mean() >= 0.93


def test_a_hot_key_does_not_swell_the_sample(spark):
    rows = [(1, prose(1, 30), 1)] * 300 + [(k, prose(k, 30), 1 if k < 40 else None) for k in range(2, 80)] + [(None, prose(500 + k, 30), None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df, df)
    assert 0 < model.prior < 1 and quality.score(df, model).count() == len(rows)
    assert np.array_equal(model.weights, quality.fit(df.repartition(7), df.repartition(3)).weights)

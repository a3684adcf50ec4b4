"""Quality classifier by positive-unlabelled learning.

Trusted positives (quality 1) and unlabelled web text are all that anything is learned from. With the class
prior p of positives and a logistic loss, the fit minimises the non-negative unbiased risk

    p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-))

by full-batch Adam in numpy on a bounded sample (POSITIVES and UNLABELLED rows, fewer if they exceed
SAMPLE_BYTES of text); where the estimated risk of negatives falls below zero, the step ascends it instead, as
the method has it. The prior is a parameter or is estimated from positives and unlabelled text alone: half of
the sample trains a classifier of one against the other, and on the other half the share of unlabelled text
above a threshold over the share of positives above it, at the threshold where its upper bound is least,
bounds the prior (best bin estimation); the halves change places and the mean counts. A text is the shares of
its hashed byte n-grams, case kept, and the share of its words that repeat the word before, so scoring looks
each n-gram of the whole text up once. Texts are never joined with the table of labels: only the texts
of the sampled positives are fetched, by their keys.

Defined results: a null text counts as empty; an empty text scores as the bias alone. Repeated rows are all
scored; in the sample they count once. A key that is marked both ways is a positive, and of several texts of
one key the first by code point is learned from. Rows without a label, or with a null key, are unlabelled text
only. Without positives every score is one half, or the prior given. Input columns named like an output column
are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .subword import BUCKETS, distinct_rows, hashed_share, prepared, sample_features, sample_rows, table_means

#: Documented bounds and settings of the fit.
POSITIVES, UNLABELLED, ORDERS, STEPS, RATE, DECAY = 2000, 3000, (1, 3), 150, 1.0, 1e-6


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # BUCKETS, and one of repetition
    bias: float
    prior: float


def repetition(text: bytes) -> float:
    """The share of the words that equal the word before."""
    words = text.split()
    return sum(map(eq, words, islice(words, 1, None))) / len(words) if words else 0.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk_slopes(z: np.ndarray, positive: np.ndarray, prior: float | None) -> np.ndarray:
    """Slope of the risk by each row's margin; of the negatives' risk, ascended, where that is below zero. Without a prior, of the plain risk of positives against unlabelled."""
    n_pos, n_unl = positive.sum(), (~positive).sum()
    up, down = -_sigmoid(-z), _sigmoid(z)  # slopes of the losses of the labels + and -
    if prior is None:
        return np.where(positive, up / n_pos, down / n_unl)
    negatives = np.logaddexp(0, z[~positive]).mean() - prior * np.logaddexp(0, z[positive]).mean()
    slope = np.where(positive, -prior * down / n_pos, down / n_unl)
    return -slope if negatives < 0 else slope + np.where(positive, prior * up / n_pos, 0.0)


def train(rows: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray, prior: float | None) -> tuple[np.ndarray, float]:
    """Weights and bias of (buckets, shares) rows; positive: which of them are trusted, the others unlabelled."""
    index, value = np.concatenate([b for b, _ in rows]), np.concatenate([s for _, s in rows]).astype(np.float64)
    starts = np.cumsum([0, *(len(b) for b, _ in rows)])[:-1]
    row = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    theta, m, v = np.zeros(BUCKETS + 2), np.zeros(BUCKETS + 2), np.zeros(BUCKETS + 2)
    theta[-1] = np.log(prior / (1 - prior)) if prior is not None else 0.0
    for step in range(1, STEPS + 1):
        slope = risk_slopes(np.add.reduceat(theta[index] * value, starts) + theta[-1], positive, prior)
        grad = np.append(np.bincount(index, value * slope[row], minlength=BUCKETS + 1), slope.sum()) + DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return theta[:-1].astype(np.float32), float(theta[-1])


def _rows(found) -> list[tuple[int, np.ndarray, np.ndarray]]:
    rows = [(y, np.asarray(b.values), np.asarray(s.values)) for y, b, s in zip(found["y"].to_pylist(), found["buckets"], found["shares"], strict=True)]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))  # the order of arrival doesn't count
    return rows


def mixture_share(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives in unlabelled text, from both kinds' held-back scores: the ratio of their shares above the threshold where its upper bound is least."""
    cuts = np.unique(positive)
    of_pos = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    of_unl = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    gap = np.sqrt(np.log(4 / confidence) / 2) * (len(unlabelled) ** -0.5 + len(positive) ** -0.5)
    best = ((of_unl + gap) / of_pos).argmin()
    return float(of_unl[best] / of_pos[best])


def estimate_prior(rows: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray) -> float:
    """The class prior among the unlabelled rows, within 0.05 and 0.95."""
    found = []
    for side in (0, 1):
        held = np.arange(len(rows)) % 2 == side
        if min(positive[held].sum(), (~positive[held]).sum(), positive[~held].sum(), (~positive[~held]).sum()) == 0:
            return 0.5
        weights, bias = train([r for r, h in zip(rows, held, strict=True) if not h], positive[~held], None)
        scores = np.array([(weights[b] * s).sum() + bias for (b, s), h in zip(rows, held, strict=True) if h])
        found.append(mixture_share(scores[positive[held]], scores[~positive[held]]))
    return float(np.clip(np.mean(found), 0.05, 0.95))


def fit(texts: DataFrame, marks: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, key: str = "doc_id", text_col: str = "text") -> Model:
    """texts: key and text; marks: key and quality (1, 0 or null). Both of the learning folds only."""
    n, size = texts.agg(F.count(F.lit(1)), F.avg(F.octet_length(text_col))).first()
    share = positives / (positives + unlabelled)
    positives, unlabelled = sample_rows(positives, size, share), sample_rows(unlabelled, size, 1 - share)
    trusted = marks.where((F.col("quality") == 1) & F.col(key).isNotNull()).select(key).distinct()
    few = trusted.where(hashed_share(positives, trusted.count(), key)).orderBy(F.xxhash64(key), key).limit(2 * positives)
    known = texts.select(key, F.col(text_col).alias("text"))
    good = known.join(F.broadcast(few), key).groupBy(key).agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(F.lit(1).alias("y"), "text")  # 2 * POSITIVES keys at most
    web = distinct_rows(known.where(hashed_share(unlabelled, n, key, "text"))).select(F.lit(0).alias("y"), "text")
    rows = _rows(sample_features(good.union(web), ORDERS, False, repetition))
    positive = np.array([r[0] == 1 for r in rows], dtype=bool)
    features = [r[1:] for r in rows]
    if not positive.any() or positive.all():
        prior = prior or 0.5
        return Model(np.zeros(BUCKETS + 1, np.float32), float(np.log(prior / (1 - prior))), prior)
    prior = estimate_prior(features, positive) if prior is None else prior
    weights, bias = train(features, positive, prior)
    return Model(weights, bias, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted."""
    bounded_batches(docs.sparkSession)
    table, of_repeats, bias = model.weights[:BUCKETS, None], float(model.weights[BUCKETS]), model.bias

    @F.arrow_udf("double")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.cast(pa.binary())]
            repeats = np.array([repetition(t) for t in texts])
            yield pa.array(_sigmoid(table_means([prepared(t, False) for t in texts], table, ORDERS)[:, 0] + of_repeats * repeats + bias))

    scored = docs.withColumn("score", udf(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

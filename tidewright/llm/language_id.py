"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams; a linear softmax on that mean gives the
languages' probabilities. Embeddings and softmax are trained together by stochastic gradient descent in numpy
on a bounded sample (PER_LANGUAGE labelled rows a language, fewer if they exceed SAMPLE_BYTES of text). A fifth of the sample is held back to fit the
temperature of the softmax, so that scores are calibrated, and the score below which a text is rejected: of
the held-back rows at most REJECTED lie below it, and it is at most UNSURE times an even share. Subwords never
seen weigh nothing, so texts in other scripts or languages score near an even share. For scoring, embeddings and softmax are multiplied out to
one small table, and each n-gram of the whole text is looked up once.

Defined results: a text that is null or has no letter is "und" with score 0, and is rejected. Languages that
are null are not learned from. Repeated rows are all scored; in the sample they count once. Without any labelled row everything is "und".
Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .subword import BUCKETS, distinct_rows, hashed_share, prepared, sample_features, sample_rows, table_means

#: Documented bounds and settings of the fit.
PER_LANGUAGE, REJECTED, ORDERS, WIDTH, EPOCHS, RATE = 500, 0.001, (2, 3), 16, 6, 0.5
#: A text is rejected for its score only if that is also below so many times an even share.
UNSURE = 1.5
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times softmax weights, over the temperature
    reject_below: float


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], n_languages: int, seed: int = 1) -> np.ndarray:
    """Embeddings times softmax weights of (language, buckets, shares) rows, by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    embed = np.zeros((BUCKETS, WIDTH), dtype=np.float32)  # subwords never seen stay at nothing, so a text of them scores low
    soft = rng.normal(0, WIDTH**-0.5, (WIDTH, n_languages)).astype(np.float32)
    steps = EPOCHS * len(rows)
    for step, k in enumerate(np.concatenate([rng.permutation(len(rows)) for _ in range(EPOCHS)]) if rows else []):
        y, buckets, shares = rows[k]
        rate = RATE * (1 - step / steps)
        mean = shares @ embed[buckets]
        p = np.exp(z := mean @ soft - (mean @ soft).max()) / np.exp(z).sum()
        p[y] -= 1
        back = soft @ p
        soft -= 0.2 * rate * np.outer(mean, p)
        embed[buckets] -= (50 * rate) * np.outer(shares, back)  # shares are small, hence the larger step
    return embed @ soft


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id") -> Model:
    """labelled: text, lang, and a key that is sampled by together with the text. Only a bounded sample of it is read out."""
    known = labelled.where("lang is not null")
    found = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.octet_length("text")).alias("bytes")).collect()  # a row a language
    counts = {r["lang"]: (r["n"], sample_rows(per_language, r["bytes"], 1 / len(found))) for r in found}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), 1.0)
    chosen = F.lit(False)
    for lang, (n, wanted) in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & hashed_share(wanted, n, key, "text"))
    number = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int") - 1
    found = sample_features(distinct_rows(known.where(chosen).select(key, number.alias("y"), "text")), ORDERS, True)
    rows = [(y, np.asarray(b.values), np.asarray(s.values)) for y, b, s in zip(found["y"].to_pylist(), found["buckets"], found["shares"], strict=True)]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))  # the order of arrival doesn't count
    held = rows[::5] if len(rows) >= 50 else rows
    table = train([r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows, len(languages))
    logits, truth = np.stack([s @ table[b] for _, b, s in held]), np.array([y for y, _, _ in held])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min(np.geomspace(1, 30, 41), key=loss)
    reject = float(np.quantile(softmax(logits / temperature).max(axis=1), REJECTED)) if len(rows) >= 50 else 0.0
    return Model(languages, (table / temperature).astype(np.float32), min(reject, UNSURE / len(languages)))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    bounded_batches(docs.sparkSession)
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    table = model.table

    @F.arrow_udf("struct<best: int, score: double>")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            p = softmax(table_means([prepared(t.as_py(), True) for t in texts.cast(pa.binary())], table, ORDERS))
            yield pa.StructArray.from_arrays([pa.array(p.argmax(axis=1), pa.int32()), pa.array(p.max(axis=1))], ["best", "score"])

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    scored = docs.withColumn("_tw_best", best(F.col(text_col)))
    return scored.withColumns(
        {
            "lang_pred": F.when(lettered, F.get(F.array(*[F.lit(x) for x in names]), F.col("_tw_best.best"))).otherwise(UNKNOWN),
            "score": F.when(lettered, F.col("_tw_best.score")).otherwise(0.0),
        }
    ).drop("_tw_best")


def reject_unknown(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with their own columns."""
    scored = predict(docs.select(F.struct("*").alias("_tw_row"), F.col(text_col).alias("_tw_text")), model, "_tw_text")
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= model.reject_below)).select("_tw_row.*")

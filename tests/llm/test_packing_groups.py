import pytest
import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import packing
from tidewright.llm.queries import tokenizer_file


def test_rows_without_or_of_one_doc_id_go_to_many_groups(spark):
    texts = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc_id"), F.when(F.col("id") < 200, F.concat(F.lit("text "), "id")).otherwise("same").alias("text"))
    found = packing.pack(texts, tokenizer_file(), packing.Capacity(tokens=64), group_pieces=20)
    sizes = [r["count"] for r in found.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert sum(sizes) == 400 and len(sizes) >= 15 and max(sizes) <= 60
    again = packing.pack(texts.repartition(3), tokenizer_file(), packing.Capacity(tokens=64), group_pieces=20)
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))


def naive_best_fit(lengths, k):
    """Vector best-fit in plain loops: (sequence, offset) of each piece."""
    full = (k.tokens, k.documents, k.attention)
    bins, out = [], []
    for length in lengths:
        need = (length, 1, length * length)
        best = None
        for number, left in enumerate(bins):
            if left[0] < 1 or left[1] < 1 or any(x < y for x, y in zip(left, need)):
                continue
            if k.score == "norm":
                score = -sum(((x - y) * w / f) ** 2 for x, y, w, f in zip(left, need, k.weights, full))
            else:
                score = sum(x * y * (w / f) ** 2 for x, y, w, f in zip(left, need, k.weights, full))
            if best is None or score > best[0] + 1e-15:
                best = score, number
        if best is None:
            bins.append(list(full))
            best = 0, len(bins) - 1
        left = bins[best[1]]
        out.append((best[1], full[0] - left[0]))
        bins[best[1]] = [x - y for x, y in zip(left, need)]
    return out


@pytest.mark.parametrize("capacity", [packing.Capacity(512), packing.Capacity(512, 6, 90_000, (1.0, 0.5, 0.5)), packing.Capacity(512, 6, 90_000, (1.0, 0.2, 0.7), "dot"), packing.Capacity(512, 3)])
def test_best_fit_equals_plain_loops(capacity):
    lengths = sorted(np.random.default_rng(7).integers(1, 300, 250).tolist(), reverse=True)
    sequence, offset = packing.best_fit(np.array(lengths), capacity)
    assert list(zip(sequence.tolist(), offset.tolist())) == naive_best_fit(lengths, capacity)


def test_the_other_capacities_count():
    """Of two sequences with as many tokens left, the one with less attention cost to spare is taken."""
    lengths = np.array([600, 300, 300, 100])
    sequence, _ = packing.best_fit(lengths, packing.Capacity(700))
    plain, _ = packing.best_fit(lengths, packing.Capacity(700, weights=(1.0, 0.0, 0.0)))
    assert sequence.tolist() == plain.tolist() == [0, 1, 1, 0]
    lengths = np.array([500, 350, 300, 260, 240, 90])  # 200, 50 and 200 left
    some = packing.best_fit(lengths, packing.Capacity(700))[0].tolist()
    assert some == [r[0] for r in naive_best_fit(lengths.tolist(), packing.Capacity(700))]


def test_sequences_are_as_few_as_the_tokens_need():
    lengths = np.sort(np.random.default_rng(3).geometric(1 / 500, 4096).clip(1, 2048))[::-1]
    sequence, _ = packing.best_fit(lengths, packing.Capacity())
    assert len(np.unique(sequence)) <= -(-lengths.sum() // 2048) + 1

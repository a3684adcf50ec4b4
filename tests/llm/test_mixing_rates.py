"""The dual's optimum and the rounding against plain computations."""

import math
import random
from collections import Counter

import pandas as pd
import pytest

from tidewright.llm import mixing


def test_rates_are_the_least_entropy_ones(spark):
    r = random.Random(2)
    bins = Counter((k, r.randint(1, 60)) for k in (0, 1) for _ in range(300))
    rows = [(k, s, n) for (k, s), n in bins.items()]
    sizes = {k: sum(s * n for j, s, n in rows if j == k) for k in (0, 1)}
    aims = {0: 1.6 * sizes[0], 1: 0.4 * sizes[1]}
    scale = {k: sum(s * s * n for j, s, n in rows if j == k) / sizes[k] for k in (0, 1)}
    sources = pd.DataFrame({"number": [0, 1], "source_size": [sizes[0], sizes[1]], "target": [aims[0], aims[1]], "scale": [scale[0], scale[1]]})
    solved = mixing._tilts(spark.createDataFrame(rows, "number long, size long, n long").repartition(3), sources)
    for k in (0, 1):
        got = lambda t: sum(n * s * min(mixing.CAP, math.exp(t * s / scale[k])) for j, s, n in rows if j == k)
        low, high = -50.0, 50.0
        for _ in range(200):
            low, high = ((low + high) / 2, high) if got((low + high) / 2) < aims[k] else (low, (low + high) / 2)
        assert solved.t[k] == pytest.approx(low, abs=1e-6)
    again = mixing._tilts(spark.createDataFrame(rows[::-1], "number long, size long, n long"), sources)
    assert again.t.tolist() == solved.t.tolist()


def test_copies_follow_the_running_target():
    own = pd.DataFrame({"number": 0, "size": [9, 5, 4, 2, 0], "n": [3, 7, 2, 10, 4], "rate": [1.9, 0.3, 2.0, 1.25, 0.7]})
    found = mixing._copies(own).set_index("size").copies
    due = got = 0
    for size, n, rate in zip(own["size"], own["n"], own["rate"]):
        due += rate * n * size
        if size == 0:
            assert found[0] == n
            continue
        best = min(range(int(mixing.CAP * n) + 1), key=lambda c: abs(got + c * size - due))
        assert abs(got + found[size] * size - due) <= abs(got + best * size - due) + 1e-9
        got += found[size] * size

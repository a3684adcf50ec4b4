import math

import numpy as np
import pytest

from tidewright.llm import embedding_dedup

from .test_text_operators import brute_components


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)


def test_equals_brute_force_over_cells_and_blocks(spark, small_cells):
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 16))
    x = np.concatenate([base[r.integers(0, 40, 260)] + 0.06 * r.normal(size=(260, 16)), base[:20], base[:20] * 3.0]).astype(np.float32)
    made = [(k, int(k % 2), v.tolist(), "x") for k, v in enumerate(x)]
    made += [(900, 0, None, "x"), (901, 0, [0.0] * 16, "x"), (902, None, made[0][2], "x"), (903, 0, [math.nan] * 16, "x"), (904, 0, [1.0, None], "x"), (905, 0, [], "x"), (906, 0, [math.inf] * 16, "x"), (907, 0, [1.0, 2.0], "x"), (5, 1, made[5][2], "x")]
    df = spark.createDataFrame(made, "vec_id long, label int, embedding array<float>, n_links string")
    found = embedding_dedup.embedding_dedup(df).collect()
    assert len(found) == len(made)
    ok = lambda v: v and None not in v and np.isfinite(v).all() and any(v)
    unit = [np.array(m[2], float) / np.linalg.norm(m[2]) if ok(m[2]) and m[1] is not None else None for m in made]
    linked = lambda a, b: unit[a] is not None and unit[b] is not None and made[a][1] == made[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98
    component = brute_components(range(len(made)), linked)
    want = {}
    for k, m in enumerate(made):
        links = sum(linked(k, j) for j in range(len(made)) if j != k)
        smallest = min(made[j][0] for j in range(len(made)) if component[j] == component[k])
        want.setdefault(m[0], set()).add((links, smallest, m[0] == smallest))
    for f in found:
        assert (f.n_links, f.component_id, f.kept) in want[f.vec_id], f
    assert embedding_dedup.embedding_dedup(df.where("false")).count() == 0


def test_cells_cover_every_link():
    r = np.random.default_rng(5)
    x = embedding_dedup.unit(r.normal(size=(400, 8)))
    y = embedding_dedup.unit(x + 0.05 * r.normal(size=x.shape))
    both = np.concatenate([x, y])
    centroids = embedding_dedup.spherical_kmeans(both, 12)
    row, cell, home = embedding_dedup.cells_of(both, centroids, 0.98)
    places = [set() for _ in both]
    homes = {}
    for a, c, h in zip(row, cell, home):
        places[a].add(c)
        if h:
            homes[a] = c
    for a, b in np.argwhere(both @ both.T >= 0.98):
        assert homes[a] in places[b] or homes[b] in places[a]

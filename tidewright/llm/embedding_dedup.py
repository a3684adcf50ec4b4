"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

Vectors are compared only under equal labels. Equal vectors are one class with a count. Unit centroids are
fitted by spherical k-means on a bounded sample and every class is assigned to the cell of its nearest
centroid. So that no link across a cell border is lost, a class also visits every later cell that a vector
within the linking angle of it could belong to (a margin test against the bisecting plane of the two
centroids). Within (label, cell), members and visitors are cut into blocks of bounded size; each pair of
blocks is one matrix product in double precision, which yields link counts and a spanning forest, never all
pairs. Cells and blocks only divide the work: the result does not depend on them.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, and any vector
without a label, links with nothing. Vectors of different lengths do not link. Repeated rows count as other
vectors. n_links counts vectors, not classes. A null vec_id is its own component where it links with nothing
and is ignored in choosing a component's smallest vec_id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components, spanning_forest

#: Documented bounds: rows that k-means is fitted on, cells, wanted classes a cell, rows a block.
SAMPLE_ROWS, MOST_CELLS, CELL_ROWS, BLOCK_ROWS = 20_000, 1024, 2048, 2048
#: Bytes of vectors that the sample holds at most, about.
SAMPLE_BYTES = 32_000_000


def usable(vector: Column) -> Column:
    big = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k unit centroids of unit rows x; an empty cell keeps its centroid."""
    centroids = x[np.random.default_rng(seed).choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1)
        centroids[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centroids


def cells_of(x: np.ndarray, centroids: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of each unit row's own cell and of the later cells that it visits."""
    near = x @ centroids.T
    home = near.argmax(axis=1)
    gap = near[np.arange(len(x)), home][:, None] - near
    between = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-30))[home]
    reach = math.sqrt(1 - cosine * cosine) * between + 1e-9
    later = np.arange(len(centroids))[None, :] > home[:, None]
    row, cell = np.nonzero(later & (gap <= reach))
    n = len(x)
    return np.concatenate([np.arange(n), row]), np.concatenate([home, cell]), np.concatenate([np.ones(n, bool), np.zeros(len(row), bool)])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(n, -1)


def fit_cells(classes: DataFrame, total: int, largest: int, longest: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, none where one cell does. classes: cid, dim, vector."""
    k = min(MOST_CELLS, -(-largest // CELL_ROWS))
    if k < 2:
        return {}
    wanted = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * longest)))
    share = F.pmod(F.xxhash64("cid"), F.lit(1_000_000)) < F.lit(int(1e6 * min(1.0, wanted / total)) + 1)
    sample = classes.where(share).select("dim", "vector").limit(2 * wanted).toArrow()
    fitted = {}
    for dim in sorted(set(sample["dim"].to_pylist())):
        own = sample.filter(pa.compute.equal(sample["dim"], dim))
        if len(own) >= 2 * k:
            fitted[dim] = spherical_kmeans(unit(_matrix(own["vector"], len(own))), k)
    return fitted


def compare(rows: pa.Table, i: int, j: int, cosine: float) -> pa.Table:
    """Link counts and a spanning forest between the members in block i and the rows in block j."""
    block = rows["block"].to_numpy()
    x, cid, copies = unit(_matrix(rows["vector"], len(rows))), rows["cid"].to_numpy(), rows["copies"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    links = np.zeros(len(rows), dtype=np.int64)
    us, vs = [], []
    for at in range(0, len(left), 512):
        part = left[at : at + 512]
        a, b = np.nonzero(x[part] @ x[right].T >= cosine)
        a, b = part[a], right[b]
        if i == j:
            a, b = a[a != b], b[a != b]
        np.add.at(links, a, copies[b])
        if i != j:
            np.add.at(links, b, copies[a])
        u, v = spanning_forest(cid[a], cid[b])
        us.append(u)
        vs.append(v)
    own = np.flatnonzero(links)
    u, v = spanning_forest(np.concatenate(us), np.concatenate(vs)) if us else (cid[:0], cid[:0])
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    return pa.table({"cid": pa.array(cid[own]), "links": pa.array(links[own]), "root": pa.array([root.get(c, c) for c in cid[own].tolist()], pa.int64())})


def embedding_dedup(vectors: DataFrame, cosine: float = 0.98, vector_col: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col(vector_col).cast("array<double>").alias("vector")).withColumn("links_at_all", usable(F.col("vector")) & F.col("label").isNotNull())
    good = rows.where("links_at_all")
    grouped = good.groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = written(grouped.withColumns({"cid": F.monotonically_increasing_id(), "dim": F.size("vector")}))
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n"), F.max("dim")).first()
    fitted = fit_cells(classes, sizes[1] or 0, sizes[0] or 0, sizes[2] or 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
                centroids = fitted.get(dim)
                row, cell, home = (np.arange(len(own)), np.zeros(len(own), int), np.ones(len(own), bool)) if centroids is None else cells_of(unit(_matrix(own["vector"], len(own))), centroids, cosine)
                yield from own.take(pa.array(row)).append_column("cell", pa.array(cell, pa.int32())).append_column("home", pa.array(home)).to_batches()

    placed = classes.select("label", "dim", "cid", "copies", "vector").mapInArrow(assign, f"label {classes.schema['label'].dataType.simpleString()}, dim int, cid long, copies long, vector array<double>, cell int, home boolean")
    placed = written(placed)
    keys = ["label", "dim", "cell"]
    blocks = placed.groupBy(*keys).agg(
        F.ceil(F.count_if("home") / BLOCK_ROWS).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / BLOCK_ROWS).cast("int").alias("visits")
    ).where("homes > 0")
    spread = F.xxhash64("cid")
    mine = F.when(F.col("home"), F.pmod(spread, F.col("homes"))).otherwise(F.col("homes") + F.pmod(spread, F.greatest("visits", F.lit(1)))).cast("int")
    last = F.col("homes") + F.col("visits") - 1
    up_to = F.transform(F.sequence(F.lit(0), F.least(F.col("block"), F.col("homes") - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    onward = F.transform(F.sequence(F.col("block") + 1, last), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    tasks = F.when(F.col("home") & (F.col("block") < last), F.concat(up_to, onward)).otherwise(up_to)
    dealt = placed.join(blocks, keys).withColumn("block", mine).withColumn("task", F.explode(tasks)).select(*keys, F.col("task.i").alias("i"), F.col("task.j").alias("j"), "block", "cid", "copies", "vector")

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        return compare(rows, key[3].as_py(), key[4].as_py(), cosine)

    found = written(dealt.groupBy(*keys, "i", "j").applyInArrow(work, "cid long, links long, root long"))
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cid")
    of_class = classes.join(counted, "cid", "left").join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = written(of_class.groupBy("component").agg(F.min("first_id").alias("component_id")))  # written, so that Spark can split a large component's join
    known = of_class.join(smallest, "component").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where("not links_at_all").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

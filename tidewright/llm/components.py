"""Connected components of an edge table by repeated contraction to a neighbour."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node but the roots: the same components as the edges u-v, in at most one edge a node."""
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        ra, rb = parent[a], parent[b]
        open_edges = ra != rb
        a, b, ra, rb = a[open_edges], b[open_edges], ra[open_edges], rb[open_edges]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    other = parent != np.arange(len(nodes))
    return nodes[other], nodes[parent[other]]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long, not null) -> node, component: the smallest node that links reach. Nodes without a link to another are left out.

    Nodes are ordered by a hash (xxhash64 of a long has no collisions), so that no order of the numbers makes
    long chains. Each round maps every node to its first neighbour or itself, follows that map once more, and
    keeps the edges between different images: about log(n) rounds, whatever the shape. The maps shrink from
    round to round and are put together from the last to the first, each result written.
    """
    live = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    steps: list[DataFrame] = []
    while not live.isEmpty():
        first = live.union(live.select("v", "u")).groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
        near = first.select(F.col("u").alias("node"), F.when(F.xxhash64("v") < F.xxhash64("u"), F.col("v")).otherwise(F.col("u")).alias("image"))
        step = written(near.join(near.select(F.col("node").alias("image"), F.col("image").alias("further")), "image").select("node", F.col("further").alias("image")))
        steps.append(step)
        moved = live.join(step.select(F.col("node").alias("u"), F.col("image").alias("iu")), "u").join(step.select(F.col("node").alias("v"), F.col("image").alias("iv")), "v")
        live = written(moved.where("iu <> iv").select(F.least("iu", "iv").alias("u"), F.greatest("iu", "iv").alias("v")).distinct())
    if not steps:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    reached = steps.pop()
    while steps:
        later = reached.select(F.col("node").alias("image"), F.col("image").alias("last"))
        reached = written(steps.pop().join(later, "image", "left").select("node", F.coalesce("last", "image").alias("image")))
    smallest = written(reached.groupBy("image").agg(F.min("node").alias("component")))  # written, so that Spark can split a large component's join
    return reached.join(smallest, "image").select("node", "component")

"""SimHash near-dedup: 64-bit fingerprints of word shingles, joined with themselves on a binary trie.

The trie of all distinct fingerprints is walked over pairs of nodes: a pair starts at (root, root), its
children are the pairs of its nodes' children, the bits in which the two prefixes differ add up, and a pair
whose sum exceeds the error budget is dropped with all that lies below it. Small leaves are compared directly.

The walk is divided among tasks by reading the bits in budget + 1 orders, each with another part of them
first: a pair within the budget has a part without difference, so in one of the orders it comes down that part
on the diagonal, both in one node. So a task is a node with itself, each fingerprint goes to budget + 1 tasks
whatever their number, and crowded nodes are divided in the same way by the bits left. Equal fingerprints are
one entry, so copies cost nothing, and a task returns a spanning forest of the links that it found, never all
pairs.

Defined results: a null or empty text, or one of white space only, has the fingerprint zero, which is linked
like any other. A text of fewer words than a shingle is one shingle. component_id is the smallest doc_id of
the rows reached by links; null doc_ids are ignored there unless a component has no other. Repeated rows are
all returned. An empty table gives no rows. Other columns are kept by near_dedup and left out of
simhash_components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written, keep_marked, row_key, text_key
from .components import connected_components, spanning_forest

BITS, SEED = 64, 42
#: Fingerprints a task, as wished for, and so many that a node is dealt on, as often as MOST_LEVELS. They divide the work; the result does not depend on them.
NODE_ROWS, CROWDED, MOST_LEVELS = 4096, 16384, 3
LEAF_PAIRS = 4096
_BLOCK = 1 << 14


def fingerprint(text: bytes | None, words_each: int = 3) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64 values; repeats count."""
    words = (text or b"").lower().split()  # on bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False)) if len(words) >= words_each else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    total, ones = 0, np.zeros(BITS, dtype=np.int64)
    while len(block := np.fromiter(islice(hashes, _BLOCK), dtype=np.uint64)):
        total += len(block)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", words_each: int = 3, name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.array([fingerprint(t.as_py(), words_each) for t in texts.cast(pa.binary())], dtype=np.uint64)
            yield pa.array(found.view(np.int64))

    return docs.withColumn(name, udf(F.col(text_col)))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def parts_of(mask: int, parts: int, most_bits: int) -> list[int]:
    """The bits that a mask leaves free, from the first on, in so many even parts; of each part at most most_bits of the first."""
    free = [b for b in reversed(range(BITS)) if not mask >> b & 1]
    return [sum(1 << b for b in free[k * len(free) // parts : (k + 1) * len(free) // parts][:most_bits]) for k in range(parts)]


def deal(fps: DataFrame, budget: int) -> DataFrame:
    """fps: distinct fp (long), as a table -> mask, value, block, i, j, fp: the tasks' rows.

    A task (mask, value, i, j) compares block i with block j of the fingerprints that have that value under the
    mask. Each pair within the budget meets in one task at least: of budget + 1 parts of the bits that are not
    under the mask one has no difference, so in the trie that reads this part first the pair stays on the
    diagonal, a node with itself, as far as the part goes. A crowded node is dealt on in the same way by the
    bits left, and after MOST_LEVELS cut into blocks, of which each meets each.
    """
    parts, tasks, level = budget + 1, [], 0
    rows, largest = fps.select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"), "fp"), {0: fps.count()}
    crowded = None  # the nodes to deal on; None: all rows
    while level < MOST_LEVELS and max(largest.values(), default=0) > CROWDED:
        here = rows if crowded is None else rows.join(crowded.select("mask", "value"), ["mask", "value"], "left_semi")
        finer = F.lit(None).cast("array<bigint>")
        for mask, n in largest.items():  # parts ** level masks at most
            bits = max(1, math.ceil(math.log2(n / NODE_ROWS)))
            finer = F.when(F.col("mask") == mask, F.array(*[F.lit(_signed(mask % (1 << BITS) | part)).cast("long") for part in parts_of(mask % (1 << BITS), parts, bits)])).otherwise(finer)
        below = here.select(F.explode(finer).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
        counts = below.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
        crowded = written(counts.where(F.col("n") > CROWDED))
        largest = {r["mask"]: r["n"] for r in crowded.groupBy("mask").agg(F.max("n").alias("n")).collect()}
        tasks.append(below.join(crowded.select("mask", "value"), ["mask", "value"], "left_anti") if largest else below)
        rows, level = below, level + 1
    single = [F.lit(0).alias(c) for c in ("block", "i", "j")]
    if crowded is None:
        return rows.select("mask", "value", *single, "fp")
    dealt = reduce(DataFrame.union, tasks).select("mask", "value", *single, "fp")
    if largest:
        cut = rows.join(crowded, ["mask", "value"]).withColumn("blocks", F.ceil(F.col("n") / CROWDED).cast("int"))
        cut = cut.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        others = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.union(others.select("mask", "value", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp"))
    return dealt


def trie_links(a: np.ndarray, b: np.ndarray, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sorted unsigned arrays of distinct fingerprints, by a walk over pairs of trie nodes."""
    one = np.uint64(1)
    pairs = np.array([[0, len(a), 0, len(b), 0]], dtype=np.int64)
    us, vs, held = [], [], 0
    for depth in range(BITS + 1):
        size_a, size_b = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        small = (size_a * size_b <= LEAF_PAIRS) | (depth == BITS)
        for alo, ahi, blo, bhi, _ in pairs[small].tolist():
            i, j = np.nonzero(np.bitwise_count(a[alo:ahi, None] ^ b[None, blo:bhi]) <= budget)
            if same and alo == blo:
                i, j = i[i < j], j[i < j]
            if len(i):
                us.append(a[alo + i])
                vs.append(b[blo + j])
                held += len(i)
        if held > 2_000_000:
            u, v = spanning_forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], len(u)
        pairs = pairs[~small]
        if not len(pairs):
            break
        shift = np.uint64(BITS - 1 - depth)

        def split(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            first = ((x[lo] >> shift) | one) << shift  # noqa: B023
            return np.clip(np.searchsorted(x, first), lo, hi)

        alo, ahi, blo, bhi, far = pairs.T
        am, bm = split(a, alo, ahi), split(b, blo, bhi)
        kids = [(alo, am, blo, bm, far), (am, ahi, bm, bhi, far), (alo, am, bm, bhi, far + 1), (am, ahi, blo, bm, far + 1)]
        if same:  # of a node with itself, the mirrored pair is left out
            itself = alo == blo
            kids[3] = tuple(k[~itself] for k in kids[3])
        pairs = np.concatenate([np.stack(k, axis=1) for k in kids])
        pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (pairs[:, 4] <= budget)]
    if not us:
        return a[:0], a[:0]
    return spanning_forest(np.concatenate(us), np.concatenate(vs))


def fingerprint_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """fps: distinct fp (long), as a table -> u, v: spanning forests, one a task, of the links within the budget."""

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        block, found = rows["block"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        i, j = key[2].as_py(), key[3].as_py()
        u, v = trie_links(np.sort(found[block == i]), np.sort(found[block == j]), budget, i == j)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return deal(fps, budget).groupBy("mask", "value", "i", "j").applyInArrow(walk, "u long, v long")


def fingerprint_components(fps: DataFrame, budget: int = 3) -> DataFrame:
    """fps: distinct fp (long), as a table -> node, component over the linked ones."""
    return connected_components(fingerprint_links(fps, budget))


def _known(thin: DataFrame, budget: int) -> DataFrame:
    """thin: doc_id, fp, as a table -> fp, component, component_id."""
    firsts = written(thin.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = fingerprint_components(firsts.select("fp"), budget).withColumnRenamed("node", "fp")
    of_fp = firsts.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = written(of_fp.groupBy("component").agg(F.min("first_id").alias("component_id")))  # written, so that Spark can split a large component's join
    return of_fp.join(smallest, "component").select("fp", "component", "component_id")


def simhash_components(docs: DataFrame, text_col: str = "text", words_each: int = 3, budget: int = 3) -> DataFrame:
    """One row a document: doc_id, fp, component_id."""
    thin = written(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col), text_col, words_each).select("doc_id", "fp"))
    return thin.join(_known(thin, budget), "fp").select("doc_id", "fp", "component_id")


def keep_firsts(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """The row of docs with the smallest doc_id of each component, nulls last, then the smallest hash of the text; of repeated rows one stays.

    rows: id (row_key of doc_id), text_key and component of every row of docs, as a table.
    """
    order = F.struct((F.col("id") == row_key(F.lit(None))).alias("last"), "id", "text_key")
    first = written(rows.groupBy("component").agg(F.min(order).alias("first")))  # written, so that Spark can split a large component's join
    marks = rows.join(first, "component").select(F.col("id").alias("doc_id"), "text_key", ((F.col("id") == F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"))
    return keep_marked(docs, marks, text_col)


def near_dedup(docs: DataFrame, text_col: str = "text", words_each: int = 3, budget: int = 3) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component, and of those the smallest hash of the text; of repeated rows one stays.

    Rows without a doc_id stay only where their component has no doc_id at all: one for each such component.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id").alias("id"), text_key(text_col).alias("text_key"), text_col)
    thin = written(with_fingerprint(keyed, text_col, words_each).select("doc_id", "id", "text_key", "fp"))
    return keep_firsts(docs, written(thin.join(_known(thin, budget), "fp").select("id", "text_key", "component")), text_col)

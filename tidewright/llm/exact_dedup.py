"""Exact dedup by content-defined chunk recipes.

Every text is normalised (each run of ASCII white space becomes one space) and cut where a rolling hash of
its last 16 bytes asks for it, so equal passages give equal chunks wherever they stand. A document becomes a
recipe: the ordered list of its chunks' 64-bit keys and SHA-256 digests. Chunks are deduplicated on the key
and verified on the digest: an identifier (key, ordinal) stands for one content, also where two contents
share a key. Documents are equal when their ordered identifier lists are. Texts never leave the task that
reads them; only keys, digests and identifiers are shuffled.

Defined results: a null text counts as empty; all empty texts are equal. Of equal texts the row with the
smallest doc_id stays, nulls last; of repeated rows with that doc_id exactly one stays. Very long texts only
have long recipes. An empty table gives no rows. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep_marked, text_key, written

#: Chunk sizes in bytes of the normalised text. The mean is about SHORTEST + 2 ** MASK_BITS.
SHORTEST, LONGEST, MASK_BITS = 512, 16384, 10

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
_BATCH_BYTES = 1 << 20


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    raw = np.frombuffer(text, dtype=np.uint8)
    space = _IS_SPACE[raw]
    if not space.any():
        return text
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return np.where(space, np.uint8(0x20), raw)[keep].tobytes()


def cut_points(text: bytes) -> list[int]:
    """Ends of the chunks; an empty text has one empty chunk."""
    size = len(text)
    if size <= SHORTEST:
        return [size]
    wished = []
    for at in range(0, size, _BATCH_BYTES):  # the 15 bytes before a slice give its first hashes their window
        low = max(0, at - 15)
        h = _GEAR[np.frombuffer(text[low : at + _BATCH_BYTES], dtype=np.uint8)]
        for shift in (1, 2, 4, 8):
            h[shift:] += h[:-shift] << np.uint32(shift)
        hits = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + low + 1
        wished.append(hits[hits > at])
    ends = np.concatenate(wished)
    cuts, at = [], 0
    while size - at > SHORTEST:
        i = np.searchsorted(ends, at + SHORTEST)
        at = min(int(ends[i]) if i < len(ends) else size, at + LONGEST, size)
        cuts.append(at)
    if at < size:
        cuts.append(size)
    return cuts


def recipe(text: bytes) -> tuple[str, list[int], list[bytes]]:
    """SHA-256 of the normalised text, and its chunks' keys and digests."""
    clean = normalise(text)
    keys, digests, at = [], [], 0
    for end in cut_points(clean):
        chunk = clean[at:end]
        keys.append(xxhash.xxh3_64_intdigest(chunk))
        digests.append(hashlib.sha256(chunk).digest())
        at = end
    return hashlib.sha256(clean).hexdigest(), keys, digests


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, keys, digests, ends = [], [], [], [0]
        for text in batch.column(1).cast(pa.binary()):
            whole, k, d = recipe(text.as_py() or b"")
            hashes.append(whole)
            keys += k
            digests += d
            ends.append(len(keys))
        chunks = pa.StructArray.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(digests, pa.binary())], ["key", "digest"])
        columns = [batch.column(0), pa.array(hashes, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha256", "chunks", *batch.schema.names[2:]])
    give_back()


def _grouped(docs: DataFrame, text_col: str, *carried: str) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256 and the carried ones of text_key."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[text_key(text_col).alias(c) for c in carried])
    extra = "".join(f", {c} long" for c in carried)
    made = thin.mapInArrow(_recipes, f"doc_id long, text_sha256 string, chunks array<struct<key: long, digest: binary>>{extra}")
    recipes = written(made.withColumn("row", F.monotonically_increasing_id()))
    own = ["row", "doc_id", "text_sha256", *carried]
    parts = recipes.select(*own, F.posexplode("chunks").alias("at", "chunk")).select(*own, "at", "chunk.key", "chunk.digest")
    # known, lists and groups are written, so that Spark can split a join's hot keys: those of a shared passage or of a large group of copies
    known = written(
        parts.groupBy("key")
        .agg(F.sort_array(F.collect_set("digest")).alias("digests"))
        .select("key", F.posexplode("digests").alias("ordinal", "digest"))
    )
    lists = written(
        parts.join(known, ["key", "digest"])
        .groupBy(*own)
        .agg(F.sort_array(F.collect_list(F.struct("at", "key", "ordinal"))).alias("ids"))
        .withColumn("ids", F.transform("ids", lambda x: F.struct(x["key"].alias("key"), x["ordinal"].alias("ordinal"))))
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    groups = written(lists.groupBy("ids").agg(first, F.count(F.lit(1)).alias("group_size")))
    return lists.join(groups, "ids").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", *carried
    )


def exact_dedup(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _grouped(docs, text_col)


def keep_first(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows one stays."""
    return keep_marked(docs, written(_grouped(docs, text_col, "text_key")), text_col)

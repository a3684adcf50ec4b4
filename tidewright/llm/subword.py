"""Hashed byte n-grams of whole texts: features for fitting, and sums of a weight table for scoring.

Both work on slices of bounded size, so that a very long text needs no more memory than a short one, and
both see each n-gram of each text exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
_SLICE = 1 << 19
#: Bytes of text that a fit's sample holds at most, about: with longer texts it has fewer rows.
SAMPLE_BYTES = 16_000_000

_SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: For translate(): white space as a space, and for folded() A-Z as a-z.
_PLAIN = bytes.maketrans(_SPACES, b" " * len(_SPACES))
_FOLDED = bytes.maketrans(_SPACES + bytes(range(65, 91)), b" " * len(_SPACES) + bytes(range(97, 123)))


def prepared(text: bytes | None, fold_case: bool) -> bytes:
    """The text with a space before and after it; an empty text stays empty."""
    return text and b" " + text.translate(_FOLDED if fold_case else _PLAIN) + b" " or b""


def hashed(raw: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte."""
    h = np.full(len(raw) - n + 1, n, dtype=np.uint32)
    for i in range(n):
        h = (h * np.uint32(0x01000193)) ^ raw[i : len(raw) - n + 1 + i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BUCKET_BITS)


def _slices(texts: list[bytes], overlap: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(text numbers, starts of their parts and of what follows, joined bytes): the last overlap bytes of a part are context."""
    owners, starts, parts, size = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), _SLICE):
            part = text[at : at + _SLICE + overlap]
            owners.append(k)
            starts.append(size)
            parts.append(part)
            size += len(part)
            if size >= _SLICE:
                yield owners, [*starts, size], b"".join(parts)
                owners, starts, parts, size = [], [], [], 0
    if owners:
        yield owners, [*starts, size], b"".join(parts)


def table_means(texts: list[bytes], table: np.ndarray, orders: tuple[int, ...]) -> np.ndarray:
    """For each prepared text the mean of table[bucket] over its n-grams of all orders; table: BUCKETS x k."""
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for owners, starts, joined in _slices(texts, max(orders) - 1):
        raw = np.frombuffer(joined, dtype=np.uint8)
        begin = np.array(starts[:-1])
        for n in orders:
            if len(raw) < n:
                continue
            values = np.concatenate([table[hashed(raw, n)], np.zeros((1, table.shape[1]), table.dtype)])
            end = np.maximum(np.minimum(np.array(starts[1:]) - n + 1, begin + _SLICE), begin)
            bounds = np.minimum(np.stack([begin, end], axis=1), len(values) - 1)
            found = np.add.reduceat(values, bounds.ravel(), axis=0)[::2]
            size = bounds[:, 1] - bounds[:, 0]
            found[size == 0] = 0
            np.add.at(sums, owners, found)
            np.add.at(counts, owners, size)
    return sums / np.maximum(counts, 1)[:, None]


def text_features(text: bytes, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The prepared text's buckets and their shares of its n-grams: at most BUCKETS entries. Without any, one bucket has the share 0."""
    counts = np.zeros(BUCKETS)
    for _, starts, joined in _slices([text], max(orders) - 1):
        raw = np.frombuffer(joined, dtype=np.uint8)
        for begin, stop in zip(starts[:-1], starts[1:], strict=True):
            for n in orders:
                if stop - begin >= n:
                    counts += np.bincount(hashed(raw[begin:stop], n)[:_SLICE], minlength=BUCKETS)
    found = np.flatnonzero(counts) if counts.any() else np.zeros(1, int)
    return found.astype(np.int32), (counts[found] / max(1.0, counts.sum())).astype(np.float32)


def sample_features(docs: DataFrame, orders: tuple[int, ...], fold_case: bool, more: Callable[[bytes], float] | None = None) -> pa.Table:
    """y, buckets, shares of each row of docs (y, text) on the driver; more(text) is the share of one bucket more.

    docs must be a bounded sample; a row takes at most BUCKETS + 1 pairs.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1).cast(pa.binary())]
            found = [text_features(prepared(t, fold_case), orders) for t in texts]
            if more:
                found = [(np.append(b, np.int32(BUCKETS)), np.append(s, np.float32(more(t or b"")))) for (b, s), t in zip(found, texts, strict=True)]
            ends = pa.array(np.cumsum([0, *(len(b) for b, _ in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in found]) if found else [], t)) for k, t in ((0, pa.int32()), (1, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["y", "buckets", "shares"])

    kind = docs.schema["y"].dataType.simpleString()
    return docs.select("y", "text").mapInArrow(extract, f"y {kind}, buckets array<int>, shares array<float>").toArrow()


def sample_rows(rows: int, mean_bytes: float | None, share: float = 1.0) -> int:
    """So many rows, or as many of that mean length as a share of SAMPLE_BYTES holds."""
    return max(1, min(rows, int(share * SAMPLE_BYTES / max(1.0, mean_bytes or 1.0))))


def hashed_share(rows: int, of: int, *columns: str):
    """A condition that holds for about rows of the rows of a table of that many, the same on every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_000)) < F.lit(int(1e6 * min(1.0, rows / max(1, of))) + 1)


def distinct_rows(sample: DataFrame) -> DataFrame:
    """Rows alike in all columns once, so that a row repeated over much of a table cannot swell a sample; repeats meet on the map side first."""
    return sample.groupBy(*sample.columns).agg(F.count(F.lit(1)).alias("repeats")).drop("repeats")

"""Bounds on what Python workers hold of whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows of an Arrow batch of whole texts, unless the session has its own number: Spark's default would hold 10,000 texts, of any length, several times outside of the heap.
BATCH_ROWS, DEFAULT_ROWS = 1000, "10000"
#: Bytes of text, about, and rows that are taken apart at once.
SLICE_BYTES, SLICE_ROWS = 1 << 19, 256


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's rows of an Arrow batch to BATCH_ROWS where they are Spark's default."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == DEFAULT_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def give_back() -> None:
    """Returns what Arrow's and the C library's allocators keep for later to the system: workers are kept between tasks, next to each other."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def text_slices(batch: pa.RecordBatch, text: int, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of batch in slices of at most most_rows rows; a slice ends with the row by which its texts, the column numbered text, reach most_bytes."""
    begin, size = 0, 0
    for at, n in enumerate(pc.binary_length(batch.column(text)).to_pylist(), 1):
        size += n or 0
        if size >= most_bytes or at - begin == most_rows:
            yield batch.slice(begin, at - begin)
            begin, size = at, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)

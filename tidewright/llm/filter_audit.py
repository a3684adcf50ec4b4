"""Interaction audit of five filters by Walsh-Hadamard sums.

Each document has a mask of the filters that it fails. Per part and label (all, good, toxic) the 32 signed
parity sums S[u] = sum over documents of (-1) ** bits(u & mask) are aggregated, one number a sum whatever the
rows; inverting the transform gives the documents of each mask exactly, since 32 divides every inverted sum.
From the 32 cells follow what every filter removes at every step of all 120 orders, and the Shapley count in
closed form: of a document that fails c filters each is the first to meet it in 120 / c orders.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * `[A-Z]` > 5 * code points; D a
character of `#$%&*|`; E identical to the text of a smaller doc_id anywhere in the table. E is found from
digests (SHA-256) that are first counted by document, so that a large group of copies meets as one row a part.

Defined results: a null text counts as empty and fails A only, or A and E; a null part is the empty string and
shares its rows. A null doc_id is neither smaller nor larger than another and has no label; rows that repeat a
doc_id and its text do not make each other fail E. A document marked both ways by repeated labels is good, or
toxic, if any of them says so. Very long texts are read in slices. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, empty_text, give_back
from .words import word_lists

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
_LATER_BYTES = bytes(range(0x80, 0xC0))  # those of a code point after its first
#: Rows without a doc_id are dealt over so many keys in the join with the labels, which they cannot match.
_NAMELESS = 1024
_CELLS, _COPY = 32, 16


def text_fails(text: bytes) -> int:
    """Bits 1, 2, 4, 8 of the filters A to D that the text fails."""
    n, seen = 0, set()
    for words in word_lists(text):
        n += len(words)
        seen.update(words)
    size = len(text)
    points = size - (0 if text.isascii() else size - len(text.translate(None, _LATER_BYTES)))
    capitals = size - len(text.translate(None, _CAPITALS))
    fails = (n < LEAST_WORDS, 100 * len(seen) < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * points, len(text.translate(None, _SIGNS)) < size)
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fails, digests = [], []
        for value in batch.column(2).cast(pa.binary()):
            text = value.as_py()
            fails.append(text_fails(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])
    give_back()


def masks(docs: DataFrame, labels: DataFrame, text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, fails (bits of A to E), n, n_good, n_toxic: documents counted by what they share. labels: doc_id, quality, toxic."""
    bounded_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text(part_col).alias("part"), empty_text(text_col).alias("text"))
    facts = thin.mapInArrow(_facts, "doc_id long, part string, fails int, digest binary")
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(_NAMELESS))).otherwise(F.lit(0)).cast("long")
    marked = lambda x: F.max(F.coalesce(F.col(x) == 1, F.lit(False)))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(marked("quality").alias("good"), marked("toxic").alias("toxic"))
    known = facts.withColumn("salt", salt).join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    alike = ["digest", "part", "fails", "good", "toxic"]
    by_id = known.groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first")
    )
    # a row a part and label for each text, however many copies it has
    leads = F.col("first") == F.min("first").over(Window.partitionBy("digest"))
    copies = by_text.withColumn("copies", F.col("named") - F.when(leads, F.col("at_first")).otherwise(0))
    kinds = F.array(F.struct(F.col("fails"), (F.col("n") - F.col("copies")).alias("n")), F.struct(F.col("fails").bitwiseOR(_COPY).alias("fails"), F.col("copies").alias("n")))
    rows = copies.select("part", "good", "toxic", F.explode(kinds).alias("kind")).select("part", "good", "toxic", "kind.*").where("n > 0")
    return rows.select("part", "fails", "n", F.when(F.col("good"), F.col("n")).otherwise(0).alias("n_good"), F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("n_toxic"))


def _sign(u: Column, mask: Column) -> Column:
    return F.lit(1) - 2 * F.bit_count(u.bitwiseAND(mask)).bitwiseAND(1)


def _inverse(sums: str) -> Column:
    """The count of each mask from the parity sums."""
    total = lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(_CELLS - 1)), F.lit(0).cast("long"), lambda got, u: got + F.get(F.col(sums), u) * _sign(u, m))
    return F.transform(F.sequence(F.lit(0), F.lit(_CELLS - 1)), lambda m: F.shiftright(total(m), 5))


def cells(counted: DataFrame) -> DataFrame:
    """part, n, n_good, n_toxic: arrays of the documents of each mask, through the parity sums. counted: rows of masks()."""
    labels = ("n", "n_good", "n_toxic")
    sums = [F.array(*[F.sum(F.col(x) * _sign(F.lit(u), F.col("fails"))) for u in range(_CELLS)]).alias(x) for x in labels]
    return counted.groupBy("part").agg(*sums).select("part", *[_inverse(x).alias(x) for x in labels])


def _where(counts: str, wanted) -> Column:
    """The sum of the cells whose mask is wanted."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(_CELLS - 1)), F.lit(0).cast("long"), lambda got, m: got + F.when(wanted(m), F.get(F.col(counts), m)).otherwise(0))


def orders(found: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of rows of cells()."""
    order = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    each = found.withColumn("filter_order", order).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = F.transform(F.split("filter_order", ""), lambda x: F.call_function("shiftleft", F.lit(1), F.ascii(x) - ord(FILTERS[0])))
    before = F.aggregate(F.slice(bits, F.lit(1), F.col("step") - 1), F.lit(0), lambda got, x: got.bitwiseOR(x))
    placed = each.withColumns({"bit": F.get(bits, F.col("step") - 1), "before": before})
    fails, earlier = (lambda m: m.bitwiseAND(F.col("bit")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    here = lambda m: fails(m) & ~earlier(m)
    share = lambda got, m: got + F.when(fails(m), F.get(F.col("n"), m) * F.get(F.array(*[F.lit(120 // max(1, c)) for c in range(6)]), F.bit_count(m))).otherwise(0)
    return placed.select(
        "part", "filter_order", "step",
        _where("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        _where("n", here).alias("removed"),
        _where("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.get(F.col("n"), F.col("bit")).alias("unique_fails"),
        _where("n_good", here).alias("good_lost"),
        _where("n_toxic", here).alias("toxic_lost"),
        F.aggregate(F.sequence(F.lit(0), F.lit(_CELLS - 1)), F.lit(0).cast("long"), share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row a part, order and step."""
    return orders(cells(masks(docs, labels, text_col, part_col)))

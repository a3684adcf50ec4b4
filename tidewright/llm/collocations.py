"""Phrase collocations by Apriori passes.

Pass k counts the phrases of k words whose two overlapping phrases of k - 1 words are both frequent; all others
cannot be. What a pass needs to know of the level before is broadcast as a bit filter of fixed size
(FILTER_BITS, whatever the corpus): every frequent phrase sets two bits, so none is missed, and a phrase that
passes by chance is counted like any other and dropped for its count. Words are counted in tasks by slices of a
language's texts, phrases meet once a slice, then by Spark's partial aggregation, so that a frequent phrase is
no hot key. Cuts are scored by one join with the level tables, and phrases inside of longer ones by the longest
ones' own parts.

Defined results: a null text counts as empty and gives nothing; a null language is "und" and shares its rows.
Repeated rows count each time. Very long texts are read in slices that overlap by k - 1 words. An empty table,
or one without a frequent phrase, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, empty_text, give_back, written

LONGEST, LEAST, FIRST, COVER_PERCENT, SCALE = 4, 30, 2000, 80, 2_000_000
#: Bits of the filter, as a power of two (8 MB), and bytes of a language's text that are counted at once.
FILTER_BITS, SLICE = 26, 1 << 22
UNKNOWN = "und"

_BREAKS, _GAPS = b".,;:!?" + bytes(range(0x0A, 0x0E)), b"\x20\x09"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_GAPS)], _KIND[list(_BREAKS)] = 1, 2
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BREAK, _EITHER = re.compile(b"[" + re.escape(_BREAKS) + b"]"), re.compile(b"[" + re.escape(_BREAKS + _GAPS) + b"]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _slices(text: bytes, k: int) -> Iterator[bytes]:
    """The text in slices that hold each phrase of k words once: a slice begins with the k - 1 words before it, if its piece does not end there."""
    at, carried = 0, b""
    while len(text) - at > SLICE and (cut := _EITHER.search(text, at + SLICE)):
        part = carried + text[at : cut.start()]
        yield part
        words = _BREAK.split(part)[-1].split() if k > 1 and text[cut.start()] in _GAPS else []
        carried, at = b"".join(w + b" " for w in words[1 - k :]), cut.end()
    yield carried + text[at:]


def _step(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    state = (state ^ word) * _STEP
    return state ^ (state >> np.uint64(29))


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter."""
    return hashes >> np.uint64(64 - FILTER_BITS), hashes & np.uint64((1 << FILTER_BITS) - 1)


def _known(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    a, b = (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) for at in _slots(hashes))
    return (a & b & np.uint64(1)).astype(bool)


def phrase_counts(lang: str, text: bytes, k: int, bits: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """Phrases of k words in the text, each once, and their counts; with bits, only those whose parts of k - 1 words are known."""
    raw = np.frombuffer(text.translate(_LOWER) + b"\n", np.uint8)
    kind = _KIND[raw]
    word = kind == 0
    edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < k:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    piece = np.cumsum(kind == 2)[starts]
    word[ends] = True  # from here each word with one space behind it
    clean = np.where(kind == 0, raw, np.uint8(32))[word]
    offsets = np.concatenate([[0], np.cumsum(ends - starts + 1)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(clean)]).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    here = np.arange(len(ids) - k + 1)
    if k > 1:
        hashes = np.array([_word_hash(w[:-1]) for w in coded.dictionary.to_pylist()], np.uint64)
        states = np.full(len(ids) - k + 2, _word_hash(lang.encode()), np.uint64)
        for j in range(k - 1):
            states = _step(states, hashes[ids[j : len(ids) - k + 2 + j]])
        known = _known(states, bits)
        here = np.flatnonzero((piece[: len(here)] == piece[k - 1 :]) & known[:-1] & known[1:])
    keys = ids[here]
    for j in range(1, k):
        if j > 1:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys << 32 | ids[here + j]
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    counts = np.diff(first, append=len(order))
    begin = here[order[first]]
    size = offsets[begin + k] - 1 - offsets[begin]
    bounds = np.concatenate([[0], np.cumsum(size)])
    flat = clean[np.arange(bounds[-1]) + np.repeat(offsets[begin] - bounds[:-1], size)]
    phrases = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])
    return phrases, counts


def _level(texts: DataFrame, k: int, bits) -> DataFrame:
    """lang, phrase, f of the phrases of k words; bits: a broadcast filter of the level before, or None."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else np.frombuffer(bits.value, np.uint64)
        held: dict[str, tuple[int, list[bytes]]] = {}

        def out(lang: str) -> pa.RecordBatch:
            phrases, counts = phrase_counts(lang, b"\n".join(held.pop(lang)[1]), k, known)
            return pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrases)), phrases, pa.array(counts, pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                for part in _slices(text.as_py(), k):
                    size, parts = held.get(lang, (0, []))
                    parts.append(part)
                    held[lang] = (size + len(part), parts)
                    if size + len(part) >= SLICE:
                        yield out(lang)
            while sum(size for size, _ in held.values()) >= 4 * SLICE:
                yield out(max(held, key=lambda x: held[x][0]))
        for lang in sorted(held):
            yield out(lang)
        give_back()

    return texts.mapInArrow(count, "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _filter(level: DataFrame) -> bytes | None:
    """The bit filter of a level's phrases, at most 2 ** FILTER_BITS bits whatever their number; None without any."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                h = np.array([_word_hash(lang.encode())], np.uint64)
                for w in phrase.split(b" "):
                    h = _step(h, np.array([_word_hash(w)], np.uint64))
                state.append(h[0])
            at = np.concatenate(_slots(np.array(state, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "bits"])

    found = level.select("lang", "phrase").mapInArrow(places, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    if not found.num_rows:
        return None
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    words[found["at"].to_numpy()] = found["bits"].to_numpy()
    return words.tobytes()


def levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n: occurrences of words) and, by number of words, the tables (lang, phrase, f) of the frequent phrases, written."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), empty_text(text_col).alias("text"))
    words = written(_level(texts, 1, None).withColumn("phrase", F.col("phrase").cast("string")))
    found = [words.where(F.col("f") >= least)]
    for k in range(2, longest + 1):
        if (bits := _filter(found[-1])) is None:
            break
        sent = spark.sparkContext.broadcast(bits)
        found.append(written(_level(texts, k, sent).where(F.col("f") >= least).withColumn("phrase", F.col("phrase").cast("string"))))
        sent.destroy()
    return words.groupBy("lang").agg(F.sum("f").alias("n")), found


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """lang, phrase, a, best: (score, cut, l, r) of the lowest-scoring cut, of equal ones the first."""
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)"))
    parts = F.array(F.struct(F.lit(True).alias("left"), F.col("head").alias("part")), F.struct(F.lit(False).alias("left"), F.expr("substring(phrase, length(head) + 2)").alias("part")))
    asked = cuts.select("lang", F.col("phrase").alias("whole"), "a", "cut", F.explode(parts).alias("p")).select("lang", "whole", "a", "cut", "p.*")
    found = asked.join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]).groupBy("lang", "whole", "a", "cut").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return found.groupBy("lang", F.col("whole").alias("phrase"), "a").agg(best)


def _covered(candidates: DataFrame, percent: int) -> DataFrame:
    """lang, phrase of the candidates inside a longer one that has percent of their occurrences or more."""
    words = F.split("phrase", " ")
    inside = lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.array_join(F.slice(words, at, n), " "))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), inside))
    longer = candidates.where("size > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), F.col("a").alias("whole"))
    most = longer.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    return candidates.join(most, ["lang", "phrase"]).where(100 * _exact(F.col("whole")) >= percent * _exact(F.col("a"))).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, first: int = FIRST, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, count and code point."""
    totals, found = levels(docs, text_col, lang_col, longest, least)
    known = found[0]
    for level in found[1:]:
        known = known.unionByName(level)
    candidates = known.withColumn("size", F.size(F.split("phrase", " "))).where("size > 1").withColumnRenamed("f", "a")
    left = _scored(candidates, known).join(_covered(candidates, cover_percent), ["lang", "phrase"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")

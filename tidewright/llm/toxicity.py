"""Toxicity by compression distance.

A text is read in windows: its words (`[^\\x20\\x09-\\x0D]+`, A-Z in lower case) with a space on both sides, cut
at WINDOW bytes. Two zstandard dictionaries are trained, one on windows of toxic and one on windows of ordinary
text; both follow a common one of everyday words, so that they differ in what is typical of their class only.
The toxic one's samples are the words that hold a byte 6-gram which more toxic than ordinary documents have, by
a log-likelihood ratio of SIGNIFICANT or more. A window's compressed length by the ordinary dictionary, less
that by the toxic one, is its distance. Every window is padded with PADDING zero bytes, which cost the same in
all: a frame so short would not be compressed otherwise, nor its last bytes be matched.

Of a text, the windows whose distance reaches each of STEPS bytes and SHARES of their own length are counted;
a logistic calibration on these counts and the number of windows gives the score. It is fitted on documents
that the dictionaries have not seen: FOLDS times on the rest of the sample, each fold by dictionaries of the
others.

The fit uses a bounded sample (TOXIC and ORDINARY rows, fewer if they exceed SAMPLE_BYTES; no row of more than
LONGEST bytes). Scoring compresses each different window of a batch once and reads whole texts.

Defined results: a null text counts as empty; an empty text is scored as one without a window that is near
toxic text. Repeated rows are all scored; in the sample they count once. A key that is marked both ways is
toxic, and of several texts of one key the first by code point is learned from. Null keys and labels are not
learned from. With fewer than LEAST rows of a class to learn from every score is 0. Input columns named like an
output column are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back
from .subword import hashed_share, sample_rows
from .words import word_lists

#: Documented bounds and settings of the fit.
TOXIC, ORDINARY, LONGEST, LEAST, FOLDS, RIDGE = 1500, 4500, 1 << 20, 10, 3, 1.0
#: Bytes of the dictionaries: the common one, and what each class adds.
COMMON_BYTES, CLASS_BYTES = 8192, 8192
GRAM, SIGNIFICANT, RATIO = 6, 15.0, 3.0
WINDOW, PADDING = 64, bytes(96)
STEPS, SHARES = (2, 3, 4, 5, 6), (0.0, 0.3, 0.4, 0.5)
#: Windows whose result a task remembers, and about how many it reads before it compresses the new ones.
REMEMBERED, AT_ONCE = 200_000, 50_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HIT_KINDS = len(STEPS) * len(SHARES)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the features, and the bias; none without a fit


def windows(text: bytes) -> Iterator[list[bytes]]:
    """The text's windows, a list a slice."""
    for words in word_lists(text.translate(_LOWER)):
        found = [b" " + w + b" " for w in words]
        if found and max(map(len, found)) > WINDOW:
            found = [w[at : at + WINDOW] for w in found for at in range(0, len(w), WINDOW)]
        yield found


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of the samples; of too few for training, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Greedy lazy matching of four bytes or more in tables that hold all of the dictionary; no headers."""
    settings = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False,
        window_log=15, hash_log=16, chain_log=16, search_log=8, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)


def lengths(by: zstandard.ZstdCompressor, found: list[bytes]) -> np.ndarray:
    """Compressed bytes of each window."""
    return np.array([len(x) for x in by.multi_compress_to_buffer([w + PADDING for w in found])], np.int64) if found else np.zeros(0, np.int64)


def hit_kinds(toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor, found: list[bytes]) -> np.ndarray:
    """For each window and each pair of a step and a share whether its distance reaches both."""
    distance = lengths(ordinary, found) - lengths(toxic, found)
    share = distance / np.maximum(1, [len(w) for w in found])
    return np.stack([(distance >= step) & (share >= least) for step in STEPS for least in SHARES], axis=1) if found else np.zeros((0, _HIT_KINDS), bool)


class Counter:
    """Counts of a text's windows by kind of hit; results of windows seen before are kept, up to REMEMBERED."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)
        self.seen: dict[bytes, np.ndarray | None] = {}

    def learn(self, found: list[bytes]) -> None:
        new = list(dict.fromkeys(w for w in found if w not in self.seen))
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen = {}
            new = list(dict.fromkeys(found))
        self.seen.update((w, kinds if kinds.any() else None) for w, kinds in zip(new, hit_kinds(self.toxic, self.ordinary, new), strict=True))

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """For each text its hits of each kind, and the number of its windows. Windows of many texts are compressed together, at most about AT_ONCE."""
        total = np.zeros((len(texts), _HIT_KINDS + 1))
        held: list[tuple[int, list[bytes]]] = []

        def add() -> None:
            self.learn([w for _, found in held for w in found])
            for i, found in held:
                hits = [kinds for w in found if (kinds := self.seen[w]) is not None]
                total[i, :-1] += np.sum(hits, axis=0) if hits else 0
                total[i, -1] += len(found)
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            for found in windows(text):
                held.append((i, found))
                size += len(found)
                if size >= AT_ONCE:
                    add()
                    size = 0
        add()
        return total


def features(counts: np.ndarray) -> np.ndarray:
    """Of rows of counts: logarithms of the hits, of the hits against the root of the windows, and of the windows."""
    hits, n = counts[:, :-1], np.maximum(1, counts[:, -1:])
    return np.concatenate([np.log1p(hits), np.log1p(4 * hits / np.sqrt(n)), np.log(n)], axis=1)


def _grams(text: bytes) -> np.ndarray:
    """The text's different 6-grams within windows, as numbers."""
    found = [np.zeros(0, np.int64)]
    for part in windows(text):
        raw = np.frombuffer(b"\n".join(part), np.uint8).astype(np.int64)
        if len(raw) < GRAM:
            continue
        n = len(raw) - GRAM + 1
        key, crosses = np.zeros(n, np.int64), np.zeros(n, bool)
        for j in range(GRAM):
            key, crosses = key << 8 | raw[j : j + n], crosses | (raw[j : j + n] == 10)
        found.append(key[~crosses])
    return np.unique(np.concatenate(found))


def contrasted(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> np.ndarray:
    """The 6-grams, sorted, that toxic texts have significantly more often than ordinary ones."""
    grams, have = np.unique(np.concatenate(toxic), return_counts=True)
    other, there = np.unique(np.concatenate(ordinary), return_counts=True)
    at = np.minimum(np.searchsorted(other, grams), len(other) - 1) if len(other) else np.zeros(len(grams), int)
    seen = np.where(other[at] == grams, there[at], 0) if len(other) else np.zeros(len(grams), int)
    expected = len(toxic) * (seen + 1) / (len(ordinary) + 1)
    gain = have * np.log(have / expected) - (have - expected)
    return grams[(have > RATIO * expected) & (gain >= SIGNIFICANT)]


def dictionaries(toxic: list[tuple[bytes, np.ndarray]], ordinary: list[tuple[bytes, np.ndarray]]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of (text, its 6-grams)."""
    wanted = set(contrasted([g for _, g in toxic], [g for _, g in ordinary]).tolist())
    words = lambda text: sorted({w for part in windows(text) for w in part})
    holds = lambda w: any(int.from_bytes(w[i : i + GRAM], "big") in wanted for i in range(len(w) - GRAM + 1))
    typical = [w for text, _ in toxic for w in words(text) if holds(w)] or [w for text, _ in toxic for w in words(text)]
    everyday = [w for text, _ in ordinary[::2] for w in words(text)]
    other = [w for text, _ in ordinary[1::2] for w in words(text)]
    common = trained(everyday, COMMON_BYTES)
    return common + trained(typical, CLASS_BYTES), common + trained(other[::2], CLASS_BYTES // 2)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, spreads and weights (with the bias) of a logistic regression with a ridge, by Newton steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.diag([*[RIDGE] * x.shape[1], 1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    return mean, spread, w


def learn(rows: list[tuple[int, bytes]]) -> Model:
    """The model of (toxic or not, text) rows, whatever their order."""
    sides = [[(t, _grams(t)) for t in sorted(t for y, t in rows if y == side)] for side in (0, 1)]
    ordinary, toxic = sides
    if min(len(ordinary), len(toxic)) < LEAST:
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0))
    counts, truth = [], []
    for fold in range(FOLDS):
        rest = [[r for i, r in enumerate(side) if i % FOLDS != fold] for side in (toxic, ordinary)]
        counter = Counter(*dictionaries(*rest))
        for y, side in ((1, toxic), (0, ordinary)):
            counts.append(counter.counts([text for text, _ in side[fold::FOLDS]]))
            truth += [y] * len(counts[-1])
    return Model(*dictionaries(toxic, ordinary), *calibrate(features(np.concatenate(counts)), np.array(truth)))


def fit(texts: DataFrame, marks: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY, key: str = "doc_id", text_col: str = "text") -> Model:
    """texts: key and text; marks: key and toxic (1, 0 or null). Both of the learning folds only."""
    known = texts.select(key, F.col(text_col).alias("text")).where(F.octet_length("text") <= LONGEST)
    mean = known.agg(F.avg(F.octet_length("text"))).first()[0]
    wanted = {y: sample_rows(n, mean, n / (toxic + ordinary)) for y, n in ((1, toxic), (0, ordinary))}
    marked = marks.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("y"))
    there = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    picked = None
    for y, n in wanted.items():  # the share is taken twice over, the limit is exact
        some = marked.where((F.col("y") == y) & hashed_share(2 * n, there.get(y, 0), key)).orderBy(F.xxhash64(key), key).limit(n)
        picked = some if picked is None else picked.unionByName(some)
    found = known.join(F.broadcast(picked), key).groupBy(key, "y").agg(F.min("text").alias("text")).select("y", "text").toArrow()
    return learn(list(zip(found["y"].to_pylist(), found["text"].cast(pa.binary()).to_pylist(), strict=True)))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with score and predicted."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(model.toxic, model.ordinary) if len(model.weights) else None
        for batch in batches:
            if counter is None:
                yield pa.array(np.zeros(len(batch)))
                continue
            counts = counter.counts([t.as_py() or b"" for t in batch.cast(pa.binary())])
            z = (features(counts) - model.mean) / model.spread
            yield pa.array(1 / (1 + np.exp(-np.clip(z @ model.weights[:-1] + model.weights[-1], -50, 50))))
        give_back()

    scored = docs.withColumn("score", udf(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

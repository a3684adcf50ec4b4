"""Best-fit packing of tokenised documents into sequences under several capacities.

A document longer than a sequence is cut into full pieces and a shorter last one. Pieces (a few numbers each;
texts and tokens never leave the task that reads them) are dealt into groups of bounded size by a hash and
each group is packed by vector best-fit: pieces come from long to short, and a piece goes to the open sequence
with the best score among those whose residual capacities of tokens, documents and attention cost (the sum of
squared lengths) all admit it. Score "norm": least weighted norm of what is left; score "dot": greatest
weighted dot-product of the piece's needs with the residuals. Sequences with no token left are closed. The
default weights count a full share of documents or of attention cost half as much as one of tokens: pieces
still fill sequences (on sf0.1 as few as the tokens need), and of sequences with about as many tokens left the
one with less attention cost and fewer documents to spare is taken first.

Defined results: a null text counts as empty; an empty text has the one token that ends a document. Repeated
rows are packed each. Of equally good sequences the oldest is taken; pieces of one length come by doc_id,
piece, ids_crc32. Group and place depend only on the rows, not on their order. An empty table gives no rows. A piece that
alone exceeds the attention capacity is an error of the settings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, row_key, text_slices, written

#: Pieces packed together, about; each group leaves about one sequence part-filled.
GROUP_PIECES = 4096
#: Words that a worker remembers the ids of, also between tasks (about 200 bytes each); when there are as many, later ones are looked up anew in each batch.
REMEMBERED = 600_000

#: Fixed value: ASCII punctuation.
_ENDINGS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.5, 0.5)
    score: str = "norm"


class WordTokenizer:
    """Ids of texts by a tokenizer file that drops white space and lower-cases, one distinct word at a time.

    No token spans white space, so a text's ids are its words' ids in order; words are looked up with A-Z
    lower-cased, and those not yet known go to the tokenizer together, as one text with a mark between them.
    Punctuation at the end of a word is a token sequence of its own, so word and ending are looked up apart.
    The file's special tokens are cut out of the raw text first; words that only look like one when lower-cased
    are ordinary text.
    """

    MARK = b"\x00"

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.mark = self._ids(self.MARK)[-1]
        added = {t.content.encode(): k for k, t in self.model.get_added_tokens_decoder().items() if t.special}
        self.special = {t: k.to_bytes(4, "little") for t, k in added.items()}
        self.cut_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")") if added else None
        self.known: dict[bytes, bytes] = {}
        self.remembered = remembered

    def _ids(self, text: bytes) -> list[int]:
        self.model.encode_special_tokens = True
        try:
            return self.model.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids  # fast: without the places of tokens in the text
        finally:
            self.model.encode_special_tokens = False

    def _learn_all(self, words: set[bytes]) -> set[bytes]:
        """Learns the words, and returns the stems and endings that it learned for them besides."""
        ended = {}
        for word in words:
            stem = word.rstrip(_ENDINGS)
            if stem != word and stem[-1:].isalnum():
                ended[word] = stem, word[len(stem) :]
        apart = set(chain.from_iterable(ended.values()))
        extra = apart.difference(self.known, words)
        self._learn([*(w for w in words if w not in ended), *extra])
        for word, (stem, ending) in ended.items():
            self.known[word] = self.known[stem] + self.known[ending]
        return extra

    def _learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 2048):
            part = words[at : at + 2048]
            for word in [w for w in part if self.MARK in w]:
                self.known[word] = np.array(self._ids(word), dtype="<u4").tobytes()
            if not (plain := [w for w in part if self.MARK not in w]):
                continue
            ids = np.array(self._ids((b" " + self.MARK + b" ").join(plain)), dtype="<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            raw, begin = ids.tobytes(), 0
            for word, end in zip(plain, ends, strict=True):
                self.known[word] = raw[4 * begin : 4 * end]
                begin = end + 1

    def encode(self, texts: list[bytes], closing: int = 0) -> list[bytes]:
        """The ids of each text and the closing id, as little-endian unsigned 32-bit numbers."""
        parts = [self.cut_special.split(t) if self.cut_special else [t] for t in texts]  # text and special token by turns
        split = [p.translate(_LOWER).split() for own in parts for p in own[::2]]
        full = len(self.known) >= self.remembered
        if new := set(chain.from_iterable(split)).difference(self.known):
            new |= self._learn_all(new)
        end, of = closing.to_bytes(4, "little"), self.known.__getitem__
        at, found = iter(split), []
        for own in parts:
            ids = [b"".join(map(of, next(at))) if k % 2 == 0 else self.special[p] for k, p in enumerate(own)]
            found.append(b"".join(ids) + end)
        for word in new if full else ():
            del self.known[word]
        return found


@cache
def _tokenizer(path: str, remembered: int) -> WordTokenizer:
    """One a worker process, kept between tasks."""
    return WordTokenizer(path, remembered)


def cut(docs: DataFrame, tokenizer_path: str, most: int, text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of at most most tokens: doc_id, piece, start, length, ids_crc32. remembered: words that a worker keeps the ids of; fewer take less memory and more time."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path, remembered)
        for whole in batches:
            for batch in text_slices(whole, 1):
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode([t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]), strict=True):
                    for k, start in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[start : start + 4 * most]
                        rows.append((doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces that come in the order given."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.float64)
    weights = np.array(capacity.weights) / full
    left = np.empty((0, 3))
    numbers = np.empty(0, dtype=np.int64)
    sequence, offset, made, open_count = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0, 0
    for k, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) * length])
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        fits = np.flatnonzero((left[:open_count] >= need).all(axis=1)) if open_count else ()
        if len(fits):
            rest = left[fits]
            score = -(((rest - need) * weights) ** 2).sum(axis=1) if capacity.score == "norm" else (rest * need * weights * weights).sum(axis=1)
            at = fits[score.argmax()]
        else:
            if open_count == len(left):
                left = np.concatenate([left, np.empty((max(64, len(left)), 3))])
                numbers = np.concatenate([numbers, np.empty(max(64, len(numbers)), np.int64)])
            at = open_count
            left[at], numbers[at] = full, made
            open_count, made = open_count + 1, made + 1
        sequence[k], offset[k] = numbers[at], capacity.tokens - left[at, 0]
        left[at] -= need
        if left[at, 0] < 1 or left[at, 1] < 1:  # closed; those after it move up, so that age decides ties
            left[at : open_count - 1] = left[at + 1 : open_count]
            numbers[at : open_count - 1] = numbers[at + 1 : open_count]
            open_count -= 1
    return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, capacity: Capacity = Capacity(), group_pieces: int = GROUP_PIECES, text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(cut(docs, tokenizer_path, capacity.tokens, text_col, remembered))
    groups = max(1, -(-pieces.count() // group_pieces))
    same = [row_key("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy(*same).orderBy("length")))  # rows without or of one doc_id go to different groups
    dealt = ranked.withColumn("pack_group", F.pmod(F.xxhash64(*same, "rank"), F.lit(groups))).drop("rank")

    def place(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = best_fit(own["length"].to_numpy(), capacity)
        return own.assign(sequence_id=own["pack_group"].to_numpy() * (1 << 32) + sequence, offset=offset).drop(columns="pack_group")

    return dealt.groupBy("pack_group").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

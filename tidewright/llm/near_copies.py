"""SimHash near-dedup up to a Jaccard similarity of word-shingle sets.

Fingerprints within a few bits find the closest copies; sets of similarity 0.8 differ in about ten bits of 64,
where no trie prunes. So the trie self-join comes first: its spanning forest, at most one link a text, is
confirmed on the whole sets, and what is confirmed becomes one component, so that large groups of close copies
are never compared pair by pair. The links beyond its budget are completed from shared shingles: two sets of
similarity t or more share one of the first n - ceil(t * n) + 1 hashes of each, in any order that holds for all
sets (prefix filter). The order is that of document frequency, rarest first, so that the prefix of a set that
is not a close copy of others is filled by hashes of its own, which meet nothing; and the first hash that two
sets share stands so early in both that the rest of each can reach t (positional filter). Sets that share such a
hash, and whose fingerprints differ in no more bits than similar
sets' do (reach()) are compared whole. That is done first for the sets that share a hash with one of them, a
leader, in groups of bounded size, which joins most of a large group of copies; then for all such pairs of
different components. Of these only spanning forests are kept, made where a hash's sets meet: a line that many
sets share makes pairs with the square of their number, and as many times as it has hashes.

Frequencies are counted in buckets of the hashes' range: chunks of sets deal out 32 bits of each hash beyond
its bucket's and the set's place in the chunk, and only hashes of several sets come back to the chunk. Bits that
collide make hashes look shared, which costs a comparison and loses nothing: a set keeps its size n, and so its
prefix is never shorter than its distinct bits need. Hashes known from a part of the texts to be very frequent
are not dealt; they come last in the order.

Only hashes, fingerprints and counts are dealt out; texts are read where they stand, and sets are made again
for the pairs to confirm. The one source of loss is reach(): five standard deviations, about one link in a
million at a similarity of exactly t, far fewer above; sets of up to FEW hashes skip it.

Defined results: A-Z are lower-cased and words are cut at ASCII white space, as for the fingerprints. A text of
fewer words than a shingle is one shingle; null and empty texts have one empty shingle and are equal. Of the
rows that links reach, the one with the smallest doc_id stays, nulls last, then the smallest hash of the text;
of repeated rows one stays. An empty table gives no rows. Other columns are kept, whatever their names. Equal
64-bit hashes count as equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, row_key, small, text_key, written
from .components import connected_components, spanning_forest
from .simhash import BITS, fingerprint_links, keep_firsts

#: Hashes that come last in the order: those in more sets than FREQUENT of the SAMPLED-th part of the texts, MOST_FREQUENT at most. They decide the work, never the result.
SAMPLED, FREQUENT, MOST_FREQUENT = 16, 8, 50_000
#: Hashes, about, in a chunk of sets, and bytes of text a bucket of hashes: some million hashes.
CHUNK_HASHES, CHUNK_SETS, BUCKET_BYTES = 1 << 19, 1 << 15, 6 << 20
#: Sets compared with each other in one group around a leader, about.
GROUP = 512
#: Rows of a hash, about, that meet in one part, rows of a task, about, and pairs held at once.
PART, TASK_ROWS, PAIRS = 1 << 11, 1 << 14, 1 << 18
#: Sets up to this size are compared whatever their fingerprints.
FEW = 16

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SMALL = 1e-9
_BLOCK, _COLUMNS = 1 << 14, 4096


def reach(similarity: float) -> int:
    """Bits in which fingerprints of similar sets differ at most: each does with probability acos(cosine) / pi, and five standard deviations are added."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(BITS * p + 5 * math.sqrt(BITS * p * (1 - p)))


def set_fingerprint(hashes: np.ndarray) -> np.uint64:
    """Bit b is 1 if it is set in over half of the hashes."""
    ones = sum(np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, len(hashes), _BLOCK))
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def shingle_set(text: bytes | None, words_each: int = 5) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    words = (text or b"").lower().split()
    if len(words) < words_each:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = len(words) - words_each + 1
    found = each[:size].copy()
    for k in range(1, words_each):
        found = (found ^ (found >> np.uint64(29))) * _MIX + each[k : k + size]
    return np.unique((found ^ (found >> np.uint64(32))) * _MIX)


def prefix_size(n: np.ndarray, similarity: float) -> np.ndarray:
    """Hashes of a set of n, in any common order, of which one at least stands in the prefix of each similar set."""
    return n - np.ceil(similarity * n - _SMALL).astype(np.int64) + 1


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Each row's key and text."""
    return docs.select(row_key("doc_id").alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))


def _of_texts(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches in small slices, with the set of each text, the last column."""
    for whole in batches:
        for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
            yield batch, [shingle_set(t.as_py(), words_each) for t in batch.columns[-1].cast(pa.binary())]
    give_back()


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def _longs(values: list) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def frequent_hashes(texts: DataFrame, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are frequent in the sets of a part of the texts, sorted, and how frequent each is."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _of_texts(batches, words_each):
            found, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["token", "n"])

    part = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLED)) == 0).select("text")
    counts = part.mapInArrow(made, "token long, n long").groupBy("token").agg(F.sum("n").alias("count"))
    top = counts.where(F.col("count") > FREQUENT).orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).collect()
    frequent = np.array([r["token"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(frequent)
    return frequent[order], (len(order) - order).astype(np.int64)


def _dealt(chunk: int, parts: list[tuple[pa.RecordBatch, list[np.ndarray]]], bits: int, frequent: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """A chunk's rows: of each bucket the places of sets in the chunk (at) and the hashes' next 32 bits (token); and one of the sets themselves (docs)."""
    sets = [s for _, found in parts for s in found]
    n = np.array([len(s) for s in sets])
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    last = np.zeros(len(hashes), dtype=bool)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        last = frequent[place] == hashes
    lasts = [rank[place[lo:hi][last[lo:hi]]] for lo, hi in zip(np.cumsum(n) - n, np.cumsum(n), strict=True)] if last.any() else [rank[:0]] * len(sets)
    ends = pa.array(np.cumsum([0, *map(len, lasts)]), pa.int32())
    hashes, owner = hashes[~last] >> np.uint64(32 - bits), owner[~last]
    first = np.ones(len(hashes), dtype=bool)  # of bits that collide within a set
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[first], owner[first]
    docs = pa.table({
        "id": pa.chunked_array([b.column(0) for b, _ in parts]), "text_key": pa.chunked_array([b.column(1) for b, _ in parts]), "node": _longs([_node(s) for s in sets]), "n": pa.array(n, pa.int64()),
        "fp": _longs([set_fingerprint(s) for s in sets]), "distinct": pa.array(np.bincount(owner, minlength=len(sets))), "last": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.sort(x) for x in lasts]))),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as stream:
        stream.write_table(docs)
    bucket = (hashes >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    cut = lambda x: np.split(x[order], starts[1:])
    at = [x.tobytes() for x in cut(owner.astype(np.uint16))] if len(found) else []
    token = [x.tobytes() for x in cut((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32))] if len(found) else []
    rows = len(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([*found.tolist(), chunk % (1 << bits)], pa.int32()), pa.array([chunk] * (rows + 1), pa.int64()), pa.array([*at, None], pa.binary()), pa.array([*token, None], pa.binary()), pa.array([None] * rows + [sink.getvalue().to_pybytes()], pa.binary())],
        ["bucket", "chunk", "at", "token", "docs"],
    )


def _shared(key: tuple, own: pa.Table) -> pa.Table:
    """A bucket's rows with the hashes of one set left out: token is all bits of the rest, df in how many sets each stands."""
    rows = own.filter(own["docs"].is_null())
    at, token = ([np.frombuffer(x.as_py(), kind) for x in rows[c]] for c, kind in (("at", np.uint16), ("token", np.uint32)))
    cuts = np.cumsum([len(x) for x in token])[:-1]
    _, place, counts = np.unique(np.concatenate([*token, np.zeros(0, np.uint32)]), return_inverse=True, return_counts=True)
    df = np.split(np.minimum(counts[place], 65535).astype(np.uint16), cuts) if len(token) else []
    high = np.int64(key[0].as_py() << 32)
    out = [(a[d > 1].tobytes(), (t[d > 1].astype(np.int64) | high).tobytes(), d[d > 1].tobytes()) for a, t, d in zip(at, token, df, strict=True)]
    none = pa.array([None] * len(out), pa.binary())
    made = pa.table({"chunk": rows["chunk"], **{c: pa.array([r[k] for r in out], pa.binary()) for k, c in enumerate(("at", "token", "df"))}, "docs": none})
    docs = own.filter(own["docs"].is_valid())
    none = pa.array([None] * len(docs), pa.binary())
    return pa.concat_tables([made, pa.table({"chunk": docs["chunk"], "at": none, "token": none, "df": none, "docs": docs["docs"]})])


def _prefixes(own: pa.Table, similarity: float) -> pa.Table:
    """The sets of a chunk with what is shared of their prefixes (tokens), and its places in the order: hashes of the set alone, then by frequency, then the very frequent."""
    docs = pa.ipc.open_stream(own.filter(own["docs"].is_valid())["docs"][0].as_py()).read_all()
    n, distinct = docs["n"].to_numpy(), docs["distinct"].to_numpy()
    rows = own.filter(own["docs"].is_null())
    at, token, df = (np.frombuffer(b"".join(x.as_py() for x in rows[c]), kind) for c, kind in (("at", np.uint16), ("token", np.int64), ("df", np.uint16)))
    order = np.lexsort((token, df, at))
    at, token = at[order].astype(np.int64), token[order]
    shared = np.bincount(at, minlength=len(n))
    place = np.arange(len(at)) - (np.cumsum(shared) - shared)[at] + (distinct - shared)[at]
    lasts = docs["last"].combine_chunks()
    many = lasts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), many)
    behind = np.arange(len(owner)) - (np.cumsum(many) - many)[owner] + distinct[owner]
    at, token, place = np.concatenate([at, owner]), np.concatenate([token, -1 - lasts.flatten().to_numpy()]), np.concatenate([place, behind])
    inside = place < prefix_size(n, similarity)[at]
    at, token, place = at[inside], token[inside], place[inside]
    order = np.argsort(at, kind="stable")
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(n)))]), pa.int32())
    listed = lambda x: pa.ListArray.from_arrays(ends, pa.array(x[order]))
    return docs.select(["id", "text_key", "node", "n", "fp"]).append_column("tokens", listed(token)).append_column("places", listed(place))


def _thin(texts: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """One row a document: id, text_key, node (of equal sets), n, fp, and the hashes of the set's prefix that other texts have, with their places."""
    frequent, rank = frequent_hashes(texts, words_each)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(31, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, hashes, sets = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch, found in _of_texts(batches, words_each):
            held.append((batch.select(["id", "text_key"]), found))
            hashes, sets = hashes + sum(map(len, found)), sets + len(found)
            if hashes >= CHUNK_HASHES or sets >= CHUNK_SETS:
                yield _dealt(chunk, held, bits, frequent, rank)
                chunk, held, hashes, sets = chunk + 1, [], 0, 0
        if held:
            yield _dealt(chunk, held, bits, frequent, rank)

    dealt = texts.mapInArrow(made, "bucket int, chunk long, at binary, token binary, docs binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "chunk long, at binary, token binary, df binary, docs binary")
    kinds = "id long, text_key long, node long, n long, fp long, tokens array<long>, places array<long>"
    return written(shared.groupBy("chunk").applyInArrow(lambda own: _prefixes(own, similarity), kinds))


def _sets(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, words_each: int) -> DataFrame:
    """node, hashes of the wanted nodes, as a table: made from the one text that stands for each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _of_texts(batches, words_each):
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], ["node", "hashes"])

    keys = wanted.distinct().join(nodes.select("node", "at.id", "at.text_key"), "node")
    rows = texts.join(small(keys), ["id", "text_key"]).select("node", "text").mapInArrow(made, "node long, hashes array<long>")
    return written(rows.groupBy("node").agg(F.min("hashes").alias("hashes")))  # repeated rows meet on the map side first


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """u, v of the pairs, a table, whose sets are similar."""
    sets = _sets(pairs.select(F.col("u").alias("node")).union(pairs.select("v")), nodes, texts, words_each)
    of = lambda end, name: sets.select(F.col("node").alias(end), F.col("hashes").alias(name))
    both = F.size(F.array_intersect("a", "b"))
    close = both >= similarity * (F.size("a") + F.size("b") - both) - _SMALL
    return written(pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").where(close).select("u", "v"))


def similar_pairs(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of all similar sets, by products of the incidence of shared hashes."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, owners = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = owners[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    overlap = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + _COLUMNS])
        incidence = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        incidence[owner[lo:hi], column[lo:hi] - first] = 1
        overlap += incidence @ incidence.T
    i, j = np.nonzero(overlap >= similarity * (sizes[:, None] + sizes[None, :] - overlap) - _SMALL)
    return i[i < j], j[i < j]


def _collapsed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """u, v: spanning forests of the similar sets among those that share a leader (of a pair, the first by hash), in groups of about GROUP sets; each set goes to one leader's group."""
    leads = F.xxhash64("u") < F.xxhash64("v")
    sides = pairs.select(F.when(leads, F.col("u")).otherwise(F.col("v")).alias("leader"), F.when(leads, F.col("v")).otherwise(F.col("u")).alias("node"))
    stars = sides.groupBy("node").agg(F.min_by("leader", F.xxhash64("leader")).alias("leader"))
    counted = written(stars.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups")))
    members = stars.join(counted, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("group"), "node")
    leaders = counted.select("leader", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("leader").alias("node"))
    grouped = members.where("node <> leader").union(leaders)
    sets = _sets(grouped.select("node"), nodes, texts, words_each)

    return _forests(grouped.join(sets, "node"), ["leader", "group"], similarity)


def _forests(rows: DataFrame, by: list[str], similarity: float) -> DataFrame:
    """u, v, a table: a spanning forest of the similar sets of each group. rows: by, node, hashes."""

    def linked(own: pa.Table) -> pa.Table:
        node = own["node"].to_numpy()
        i, j = similar_pairs([np.asarray(h.values) for h in own["hashes"].combine_chunks()], similarity)
        u, v = spanning_forest(node[i], node[j])
        return pa.table({"u": u, "v": v})

    return written(rows.select(*by, "node", "hashes").groupBy(*by).applyInArrow(linked, "u long, v long"))


def _compared(pairs: DataFrame, links: DataFrame, nodes: DataFrame, texts: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """u, v: spanning forests of the similar sets among the pairs and some more.

    Pairs hang together in clusters: copies of copies that are hardly less alike than links. A cluster is cut
    into blocks of about GROUP sets, and each block meets each, so that a set is moved once a block, not once a
    pair. Components of more sets than that have blocks of their own, which do not meet each other.
    """
    clusters = connected_components(pairs).withColumnRenamed("component", "cluster").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = written(clusters)
    sized = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.when(F.col("n") > GROUP, F.col("component")))
    counts = written(sized.groupBy("cluster", "own").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("blocks")))
    large = small(sized.where("own is not null").select("cluster", "component", "own"))
    same = F.col("a.cluster").eqNullSafe(F.col("b.cluster")) & F.col("a.own").eqNullSafe(F.col("b.own"))
    known = members.join(large, ["cluster", "component"], "left").alias("a").join(counts.alias("b"), same).select("a.cluster", "a.own", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    label = F.xxhash64(F.coalesce("own", F.lit(0)), F.col("own").isNull(), "block").alias("label")
    placed = written(known.select("cluster", "own", label, "node"))
    blocks = placed.select("cluster", "own", "label").distinct()
    left, right = (blocks.select("cluster", F.col("own").alias(f"own_{e}"), F.col("label").alias(e)) for e in "ij")
    tasks = left.join(right, "cluster").where("i <= j and not coalesce(own_i = own_j, false)").select("cluster", "i", "j")
    parts = tasks.withColumn("label", F.explode(F.array_distinct(F.array("i", "j"))))
    sets = _sets(members.select("node"), nodes, texts, words_each)
    return _forests(placed.select("cluster", "label", "node").join(sets, "node").join(parts, ["cluster", "label"]), ["cluster", "i", "j"], similarity)


def _met(own: pa.Table, similarity: float) -> pa.Table:
    """u, v: a spanning forest of the pairs of different components that may be similar, among the rows of each part, those marked first with those marked second."""
    own = own.sort_by("part")
    part, node, n, place, component, first, second = (own[c].to_numpy() for c in ("part", "node", "n", "place", "component", "first", "second"))
    fp = own["fp"].to_numpy().view(np.uint64)
    one, other = np.flatnonzero(first), np.flatnonzero(second)
    lo, hi = np.searchsorted(part[other], part[one]), np.searchsorted(part[other], part[one], side="right")
    slices = np.flatnonzero(np.diff(np.cumsum(hi - lo) // PAIRS, prepend=0))
    u = v = np.zeros(0, np.int64)
    for some in np.split(np.arange(len(one)), slices):
        many = (hi - lo)[some]
        a = np.repeat(one[some], many)
        b = other[np.arange(len(a)) + np.repeat(lo[some] - np.cumsum(many) + many, many)]
        # from the first hash that two similar sets share, enough is left of both
        left = np.minimum(n[a] - place[a], n[b] - place[b]) >= similarity / (1 + similarity) * (n[a] + n[b]) - _SMALL
        may = left & (component[a] != component[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - _SMALL)
        a, b = a[may], b[may]
        near = (np.minimum(n[a], n[b]) <= FEW) | (np.bitwise_count(fp[a] ^ fp[b]) <= reach(similarity))
        u, v = spanning_forest(np.concatenate([u, node[a[near]]]), np.concatenate([v, node[b[near]]]))
    return pa.table({"u": u, "v": v})


def _candidates(moved: DataFrame, similarity: float) -> DataFrame:
    """u, v, a table: spanning forests of the pairs of different components that share a hash and may be similar. moved: token, node, n, fp, place, component.

    Only what hangs together counts (_compared), so the pairs are neither joined nor kept: those of a hash are
    many when many sets that are not similar have it, and sets share many hashes. Of each hash with several
    components, the rows of all but its largest meet all rows, in parts of about PART rows of either.
    """
    each = moved.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    counts = each.groupBy("token").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all")).where("most.n < all")
    blocks = lambda n: F.ceil(n / PART).cast("int")
    several = small(counts.select("token", F.col("most.component").alias("largest"), blocks(F.col("all") - F.col("most.n")).alias("rows"), blocks(F.col("all")).alias("columns")))
    lesser = F.col("component") != F.col("largest")
    at = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    mixed = moved.join(several, "token").withColumns({"lesser": lesser, "row": at("rows"), "column": at("columns")})
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.col("column").alias("j")))
    along = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(F.col("row").alias("i"), j.alias("j")))
    meets = F.explode(F.when(F.col("lesser"), F.array_union(down, along)).otherwise(down)).alias("meet")
    first, second = F.expr("lesser and row = meet.i").alias("first"), F.expr("column = meet.j").alias("second")
    rows = written(mixed.select("*", meets).select(F.xxhash64("token", "meet.i", "meet.j").alias("part"), "node", "n", "place", "fp", "component", first, second))
    tasks = max(1, math.ceil(rows.count() / TASK_ROWS))
    return written(rows.groupBy(F.pmod("part", F.lit(tasks)).alias("task")).applyInArrow(lambda own: _met(own, similarity), "u long, v long").distinct())


def _fingerprint_pairs(nodes: DataFrame, budget: int) -> DataFrame:
    """u, v: the trie join's spanning forest between nodes, and nodes of one fingerprint with the first of them."""
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    links = written(fingerprint_links(firsts.select("fp"), budget))
    of = lambda end, name: firsts.select(F.col("fp").alias(end), F.col("first").alias(name))
    across = links.join(of("u", "a"), "u").join(of("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    within = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    return written(across.union(within).distinct())


def similar_components(docs: DataFrame, text_col: str = "text", words_each: int = 5, similarity: float = 0.8, budget: int = 3) -> DataFrame:
    """One row a document: id (row_key of doc_id), text_key, component over sets of that similarity."""
    texts = _texts(docs, text_col)
    thin = _thin(texts, words_each, similarity)
    nodes = written(thin.groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("at"), F.min("n").alias("n"), F.min("fp").alias("fp")))
    about = nodes, texts, words_each, similarity
    close = _confirmed(_fingerprint_pairs(nodes, budget), *about)

    tokens = thin.select("node", "n", "fp", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("node", "n", "fp", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    ends = lambda rows, of: rows.groupBy("token").agg(F.min(of).alias("lo"), F.max(of).alias("hi")).where("lo <> hi").select("token")
    live = written(tokens.join(small(ends(tokens, "node")), "token").distinct())
    # from the first hash that two similar sets share, enough is left of both
    left = f"least(u_n - u_place, v_n - v_place) >= {similarity / (1 + similarity)} * (u_n + v_n) - {_SMALL}"
    may = f"u_n >= {similarity} * v_n - {_SMALL} and v_n >= {similarity} * u_n - {_SMALL} and {left} and (least(u_n, v_n) <= {FEW} or bit_count(u_fp ^ v_fp) <= {reach(similarity)})"
    enough = lambda pairs: written(pairs.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct())

    end = lambda rows, e: rows.select("token", *(F.col(c).alias(f"{e}_{c}") for c in rows.columns if c != "token"))
    first = F.min(F.struct(F.xxhash64("node").alias("by"), "node", "n", "place", "fp")).alias("l")
    leaders = written(live.groupBy("token").agg(first).select("token", "l.node", "l.n", "l.place", "l.fp"))
    stars = enough(end(live, "v").join(end(leaders, "u"), "token").where(f"u_node <> v_node and {may}"))
    edges = written(close.union(_collapsed(stars, *about)))

    links = written(connected_components(edges))
    moved = written(live.join(links, "node", "left").withColumn("component", F.coalesce("component", "node")))
    links = written(connected_components(edges.union(_compared(_candidates(moved, similarity), links, *about))))
    return thin.select("id", "text_key", "node").join(links, "node", "left").select("id", "text_key", F.coalesce("component", "node").alias("component"))


def near_dedup(docs: DataFrame, text_col: str = "text", words_each: int = 5, similarity: float = 0.8, budget: int = 3) -> DataFrame:
    """Of the rows of docs that links of that similarity reach, the one with the smallest doc_id."""
    return keep_firsts(docs, written(similar_components(docs, text_col, words_each, similarity, budget)), text_col)

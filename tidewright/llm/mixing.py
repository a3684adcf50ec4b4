"""Mixing sources to target weights by entropy balancing.

Targets: the sources share the budget by weight; a target stops at CAP times its source's size and the excess
is reshared by weight until none is above. Rates: among all rates r in [0, CAP] that give a source its target
tokens, the one with the least relative entropy to taking each document once is r = min(CAP, exp(t * size /
scale)): exponentially tilted by document size, with one dual variable t a source. The convex dual is solved
by Newton iterations, each one Spark aggregation of gradient and curvature over the counts by (source, size),
in whole numbers, so that reruns agree whatever the order of rows;
a step that leaves the bracket known so far is replaced by its middle. Rounding: copies of equal documents
are dealt by size from large to small, each size taking the whole number of copies that brings the source's
running total nearest to the running target, so that only the smallest sizes are left to balance; within a
size, documents get the lower or the higher count by a hash of doc_id.

Defined results: a null text has size 0, and takes one copy of nothing. A null source is a source, last in
order. Repeated rows count each. A source of size 0 has target 0. An empty table gives no rows. Ties in the
hash are broken by doc_id; rows alike in it too share one rank order, whichever comes first. The sources are
the mixture's components: their list (a row each) is held by the driver, documents never are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, empty_text, small, written

CAP = 2.0
MOST_ROUNDS, CLOSE = 60, 1e-9
#: Parts of one in which rates are summed.
UNIT = 2**40
#: Documents of one (source, size) that are ranked together at most, about.
RANKED = 512


def words(text: str) -> Column:
    return F.regexp_count(empty_text(text), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], budget: float, cap: float = CAP) -> list[float]:
    """Shares of the budget by weight, stopped at cap times the size, the excess reshared until none is above."""
    found, free, left = [0.0] * len(sizes), set(range(len(sizes))), budget
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                found[i] = left * weights[i] / total
            break
        for i in over:
            found[i] = cap * sizes[i]
        left -= sum(found[i] for i in over)
        free -= set(over)
    return found


def _exact_sum(rate: Column) -> Column:
    """Of n * size * rate in whole UNIT-th parts, so that the order of rows does not count."""
    return F.sum((F.col("n") * F.col("size")).cast("decimal(18,0)") * F.floor(rate * UNIT).cast("decimal(19,0)"))


def _tilts(bins: DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """sources (number, target, scale) with the dual variable t of each; bins: number, size, n."""
    spark = bins.sparkSession
    solved = sources.assign(t=0.0, low=-math.inf, high=math.inf, done=(sources.target <= 0) | (sources.target >= CAP * sources.source_size * (1 - CLOSE)))
    for _ in range(MOST_ROUNDS):
        if solved.done.all():
            break
        duals = spark.createDataFrame(pa.Table.from_pandas(solved.loc[~solved.done, ["number", "t", "scale"]], preserve_index=False))
        z = F.col("size") / F.col("scale")
        tilted = F.exp(F.least(F.col("t") * z, F.lit(math.log(CAP))))
        free = F.col("t") * z < F.lit(math.log(CAP))
        slope = F.when(free, tilted * z).otherwise(0.0)
        sums = bins.join(duals, "number").groupBy("number").agg(_exact_sum(tilted).alias("got"), _exact_sum(slope).alias("curve")).collect()  # a row a source
        for r in sums:
            s = solved.index[solved.number == r["number"]][0]
            got, curve = float(r["got"]) / UNIT, float(r["curve"]) / UNIT
            t, gap = solved.at[s, "t"], got - solved.at[s, "target"]
            if abs(gap) <= CLOSE * max(1.0, solved.at[s, "target"]):
                solved.at[s, "done"] = True
                continue
            solved.at[s, "high" if gap > 0 else "low"] = t
            low, high = solved.at[s, "low"], solved.at[s, "high"]
            step = t - gap / curve if curve > 0 else math.nan
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low + high) else (2 * t + 1 if gap < 0 else 2 * t - 1)
            solved.at[s, "t"] = step
    return solved


def _copies(frames: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for each size of one source, from large to small, by the running target."""
    own = frames.sort_values("size", ascending=False)
    due, got, copies = 0.0, 0, []
    for size, n, rate in zip(own["size"], own["n"], own["rate"], strict=True):
        due += rate * n * size
        c = n if size == 0 else min(int(CAP * n), max(0, math.floor((due - got) / size + 0.5)))
        got += c * size
        copies.append(c)
    return own.assign(copies=copies)[["number", "size", "n", "copies"]]


def _solved(spark: SparkSession, thin: DataFrame, weight_of: Callable[[int], float], budget_share: float) -> tuple[DataFrame, DataFrame] | None:
    """(source, number, source_size, target) and, by number and size, the documents there are and the copies they get in all; None of an empty table. thin: source, size."""
    bins = written(thin.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    found = bins.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum((F.col("n") * F.col("size")).cast("decimal(18,0)") * F.col("size").cast("decimal(18,0)")).alias("squares")).collect()  # a row a source
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["source_size"] for r in found]
    aims = targets(sizes, [float(weight_of(k)) for k in range(len(found))], budget_share * sum(sizes))
    sources = pd.DataFrame({"number": range(len(found)), "source_size": sizes, "target": aims, "scale": [max(1.0, float(r["squares"]) / max(1, r["source_size"])) for r in found]})
    # Arrow tables become local relations; lists of rows would start Python workers of their own beside those that hold Python functions
    numbers = spark.createDataFrame(pa.table({"source": pa.array([r["source"] for r in found], pa.string()), "number": pa.array(range(len(found)), pa.int64()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(aims, pa.float64())}))
    numbered = bins.join(numbers, _same_source(bins, numbers)).select("number", "size", "n")
    if not found:
        return None
    solved = _tilts(written(numbered), sources)
    full = solved.target >= CAP * solved.source_size * (1 - CLOSE)
    duals = spark.createDataFrame(pa.Table.from_pandas(solved.assign(full=full & (solved.target > 0), none=solved.target <= 0)[["number", "t", "scale", "full", "none"]], preserve_index=False))
    tilt = F.exp(F.least(F.col("t") * F.col("size") / F.col("scale"), F.lit(math.log(CAP))))
    rated = numbered.join(duals, "number").select("number", "size", "n", F.when(F.col("full"), CAP).when(F.col("none"), 0.0).otherwise(tilt).alias("rate"))
    dealt = written(rated.groupBy("number").applyInPandas(_copies, "number long, size long, n long, copies long"))
    return numbers, dealt


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def mix(docs: DataFrame, weight_of: Callable[[int], float], budget_share: float = 1.5, text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken.

    weight_of: the weight of the source that is k-th by code point (from 0), null last. The table is read once;
    what follows works on (doc_id, source, size).
    """
    spark = docs.sparkSession
    thin = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(text_col).alias("size")))
    if (found := _solved(spark, thin, weight_of, budget_share)) is None:
        return thin.select("doc_id", "source", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("copies"), F.col("size").alias("taken"))
    numbers, dealt = found
    tagged = thin.join(numbers, _same_source(thin, numbers)).select("doc_id", thin["source"], "size", "source_size", "target", "number")
    return _deal(tagged, dealt)


def _deal(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """Give each document of a size the lower or the higher whole number of copies, ranked by hash in groups of bounded size."""
    hashed = F.xxhash64("doc_id")
    grouped = (
        docs.join(dealt, ["number", "size"])
        .withColumns({"h": hashed, "groups": F.ceil(F.col("n") / RANKED)})
        .withColumn("group", F.pmod(F.xxhash64("h"), F.col("groups")))
        .repartition("number", "size", "group")
    )
    one = Window.partitionBy("number", "size", "group")
    more = F.col("copies") % F.col("n")
    # a single group gives exactly the copies due; of several, each gives its share, rounded by a hash of the group
    share = more * F.count(F.lit(1)).over(one) / F.col("n")
    extra = F.when(F.col("groups") == 1, more.cast("double")).otherwise(F.floor(share + F.pmod(F.xxhash64("number", "size", "group"), F.lit(1000)) / 1000.0))
    rank = F.row_number().over(one.orderBy("h", "doc_id"))
    copies = F.floor(F.col("copies") / F.col("n")) + (rank <= extra).cast("long")
    return grouped.withColumn("got", copies).select("doc_id", "source", "size", "source_size", "target", F.col("got").alias("copies"), (F.col("got") * F.col("size")).alias("taken"))


#: Documents of one (source, size) up to which apply_mix ranks their hashes; of more, it takes a share of all hashes.
EXACT = 100_000


def apply_mix(docs: DataFrame, weight_of: Callable[[int], float], budget_share: float = 1.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, each as many times as it has copies.

    Each (source, size) has a lower number of copies and the hash of (doc_id, text) up to which its documents get
    one more; these rows, as many as there are sizes, are joined with the texts, which stay where they are. So
    null and repeated doc_ids are told apart by their texts; only rows alike in both get the same number.
    """
    spark, own = docs.sparkSession, [F.col(f"`{x}`") for x in docs.columns]
    hashed = F.xxhash64(F.col("doc_id").cast("long"), text_col)
    thin = written(docs.select(F.col("source").cast("string").alias("source"), words(text_col).alias("size"), hashed.alias("h")))
    if (found := _solved(spark, thin, weight_of, budget_share)) is None:
        return docs
    numbers, dealt = found
    bins = dealt.join(numbers.select("number", "source"), "number").select("source", "size", "n", "copies")
    bins = bins.withColumns({"least": F.floor(F.col("copies") / F.col("n")), "more": F.col("copies") % F.col("n")})
    lowest, span = float(-(2**63)), float(2**64)
    share = (F.lit(lowest) + F.col("more") / F.col("n") * span).cast("long")
    few = bins.where((F.col("n") <= EXACT) & (F.col("more") > 0)).select(F.col("source").alias("_s"), F.col("size").alias("_n"), "more")
    place = F.row_number().over(Window.partitionBy("source", "size").orderBy("h"))
    ranked = thin.join(few, thin["source"].eqNullSafe(few["_s"]) & (thin["size"] == few["_n"])).select("source", "size", "h", "more", place.alias("place"))
    cuts = ranked.where("place = more").select(F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("h").alias("cut"))
    cut = F.when(F.col("more") > 0, F.coalesce("cut", share))
    counts = bins.join(cuts, bins["source"].eqNullSafe(cuts["_s"]) & (bins["size"] == cuts["_n"]), "left")
    counts = small(counts.select(F.col("source").alias("_tw_source"), F.col("size").alias("_tw_size"), "least", cut.alias("cut")))
    keyed = docs.select(F.struct(*own).alias("_tw_row"), F.col("source").cast("string").alias("_tw_own"), words(text_col).alias("_tw_words"), hashed.alias("_tw_h"))
    joined = keyed.join(counts, F.col("_tw_own").eqNullSafe(F.col("_tw_source")) & (F.col("_tw_words") == F.col("_tw_size")))
    copies = F.col("least") + F.coalesce(F.col("_tw_h") <= F.col("cut"), F.lit(False)).cast("long")
    return joined.select("_tw_row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_tw_copy")).select("_tw_row.*")

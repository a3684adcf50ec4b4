"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bounded_batches, give_back, text_slices  # noqa: F401  the last two are for the operators

#: The white space of the contracts, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors see; a local one is made only where that is unset and the master is local, as in tests."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder := tempfile.mkdtemp(prefix="checkpoint-"))
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder, its lineage cut, so that lost executors cost no more than a task's reading.

    Unlike a checkpoint, the table has its real size for Spark to choose joins by; estimates carried on from
    table to table would double their digits with each self-join.
    """
    bounded_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_text(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def with_outputs(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the output columns added; an input column of the same name is replaced."""
    return df.withColumns(columns)


def row_key(doc_id: Column | str) -> Column:
    """doc_id as a key that joins and groups with one shuffle; the smallest long stands for null."""
    return F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long"), F.lit(-(2**63)))


#: Keys up to which a table of them is broadcast (24 bytes each); beyond, it is joined by a shuffle.
BROADCAST_KEYS = 500_000


def small(keys: DataFrame) -> DataFrame:
    """The table of keys, written, with the hint to broadcast it if it is small."""
    keys = written(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def text_key(text: Column | str) -> Column:
    """A hash of the whole text as it stands: with row_key it finds a row again."""
    return F.xxhash64(text)


def keep_marked(docs: DataFrame, marks: DataFrame, text_col: str) -> DataFrame:
    """The rows of docs that marks keep. marks: doc_id, text_key, kept for every row of docs.

    Only keys of rows that go are joined, so texts stay where they are unless there are more than BROADCAST_KEYS
    of these. Of rows alike in doc_id and text at most one stays: the first by a hash of all its columns.
    """
    of = [row_key("doc_id").alias("_tw_id"), F.col("text_key").alias("_tw_text")]
    counts = marks.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("stays")).where("n > 1 or not stays")
    going = written(counts.select("_tw_id", "_tw_text", F.col("stays").alias("again")))
    keys = ["_tw_id", "_tw_text"]
    keyed = docs.withColumns({"_tw_id": row_key("doc_id"), "_tw_text": text_key(text_col)})
    own = [F.col(f"`{c}`") for c in docs.columns]
    kept = keyed.join(small(going.select(*keys)), keys, "left_anti").select(*own)
    repeated = going.where("again").select(*keys)
    if repeated.isEmpty():
        return kept
    whole = F.struct(*own)
    first = keyed.join(small(repeated), keys, "left_semi").groupBy(*keys).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row"))
    return kept.union(first.select("row.*"))

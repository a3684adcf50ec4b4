"""Training text from documents: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the
next one's docs. All but the last return the columns of documents, whatever else these are named.

Defined results: a null or empty text, or one without a letter, has no language and goes in the first stage. A
null doc_id is an id like any other in the first, fourth and fifth stage; of texts alike, or nearly so, a row
with a doc_id stays before one without, then the smallest doc_id, and of repeated rows one. A null source is a
source, last in order. Very long texts are read whole. An empty table gives no rows in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import exact_dedup, language_id, mixing, near_copies, packing
from tidewright.llm.common import shared_folder
from tidewright.llm.queries import SEQUENCE_TOKENS, source_weight, tokenizer_file

#: Words that a worker remembers in the last stage: fewer than op10's, since the executors hold what four stages have left in memory.
REMEMBERED = 100_000

#: No stage but exact dedup can be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID, learned from the labelled ones, does not reject."""
    return language_id.reject_unknown(docs, language_id.fit(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingle sets of Jaccard similarity 0.8 or more, the one with the smallest doc_id: SimHash links on the trie, completed beyond its budget."""
    return near_copies.near_dedup(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs, source_weight)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs, tokenizer_file(), packing.Capacity(tokens=SEQUENCE_TOKENS), remembered=REMEMBERED)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", no_near_copies),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What goes between stages is written under spark.checkpoint.dir, which all executors share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

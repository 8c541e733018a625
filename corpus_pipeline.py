"""Corpus pipeline: toxicity, line dedup, near-duplicates, mixing, packing, over the table ``documents``.

Every stage takes what its predecessor kept, written as Parquet, and all but the last return the columns of documents:

1. ``toxicity`` drops documents that the classifier predicts to be toxic; it learns from ``labels``, held-out fold excluded.
2. ``line_dedup`` drops lines of at least 20 characters that 3 documents hold, but for one document; ``n_chars`` follows
   the text. No document goes, also if it has no line left.
3. ``near_dedup`` keeps one document of each class of near-duplicates (shingles of five words, similarity 0.8).
4. ``mixing`` puts the documents in the order of the mix: files in turn, rows in turn. No document goes.
5. ``packing`` returns the pieces of documents with their places in sequences. Consecutive stretches of the mix are packed,
   and the sequences are numbered and written in that order.

Null and empty texts, repeated rows, empty tables and further columns are treated as the operators state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.llm import line_dedup, mixing, near_dedup, packing, toxicity
from tablesync.llm.common import shielded, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Pieces of a stretch of the mix that is packed as a whole. Sequences of a stretch have the sources in its shares.
STRETCH_PIECES = 4096


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, (key, text, n_chars) = shielded(docs, "doc_id", "text", "n_chars")
    kept = line_dedup.dedup_lines(named, key, text)
    return kept.withColumn(n_chars, F.length(text).cast(named.schema[n_chars].dataType)).select(named.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, (key, source) = shielded(docs, "doc_id", "source")
    return mixing.in_order(mixing.mix(named, doc_id=key, source=source)).select(named.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, group_pieces=STRETCH_PIECES)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and min-max hashing are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

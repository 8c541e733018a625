"""Helpers that the operators of this subpackage share: staged tables, words, 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.sinks.files import stage
from tablesync.sources.folders import fresh_folder

#: What the operators strip from lines and split words at: blank, tab, line feed, vertical tab, form feed, return.
SPACE = " \t\n\v\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    return stage(df, fresh_folder(df.sparkSession, name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: Column) -> Column:
    """A text as bytes, so that tasks get it without decoding; null becomes the empty text."""
    return F.coalesce(column, F.lit("")).cast("binary")


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. On bytes, both methods know ASCII only."""
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """Pseudo-random odd 64-bit multipliers, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def ngram_hashes(hashes: np.ndarray, offsets: tuple[int, ...], seed: int = 0) -> np.ndarray:
    """One hash for each place at which words at these offsets exist; (0, 1, 2) are shingles, (0, 2) a skip-gram."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, seed, np.uint64)
    for offset, factor in zip(offsets, odd_numbers(len(offsets), 7 + seed), strict=True):
        total += hashes[offset : offset + n] * factor
    return mix(total)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``k`` words; of fewer words the whole sequence; of none nothing."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = word_hashes(tokens)
    return np.unique(ngram_hashes(hashes, tuple(range(min(k, len(tokens))))))


def by_batch(function):
    """For mapInArrow: ``function(batch) -> batch`` on every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return run


def shielded(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The rows under column names that clash with nothing, and the new names of some columns."""
    fresh = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), [fresh[n.lower()] for n in names]


def restored(rows: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """Shielded rows under their old column names, with new columns; a new one replaces an old one of its name."""
    gone = {n.lower() for n in new}
    old = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in gone]
    return rows.select(*old, *(c.alias(n) for n, c in new.items()))

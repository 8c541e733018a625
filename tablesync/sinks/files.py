"""Staged extracts and the delimited text export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablesync.functions.columns import quoted, resolve_key
from tablesync.functions.text import export_text
from tablesync.model import Key
from tablesync.operators.keyed import KeyStats, changed_keys, key_stats, stats_of


def stage(df: DataFrame, path: str, spark: SparkSession | None = None) -> DataFrame:
    """Write an extract and return it as a table: freezes a mutable source and cuts the lineage.

    The files outlive the loss of any executor; the path must be on a file system that all of them share.
    """
    df.write.mode("overwrite").parquet(path)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(path)


def write_keys(keys: DataFrame, key: Key, path: str, spark: SparkSession | None = None) -> tuple[DataFrame, KeyStats]:
    """Write a key set and measure it in the same job; the counters sit in its last stage."""
    seen = Observation()
    staged = stage(keys.observe(seen, *key_stats(keys, key)), path, spark)
    return staged, stats_of(keys, key, seen.get)


def stage_keys(changes: DataFrame, key: Key, path: str, spark: SparkSession | None = None) -> tuple[DataFrame, KeyStats]:
    """Write and measure the distinct keys of a change set."""
    return write_keys(changed_keys(changes, key), key, path, spark)


def cluster_by_key(df: DataFrame, key: Key) -> DataFrame:
    """Rows range-partitioned and sorted by key, for an extract that is read in key order."""
    keys = [quoted(k) for k in resolve_key(df, key)]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def tsv_encode(df: DataFrame) -> DataFrame:
    """Every column as export text."""
    return df.select(*[export_text(F.col(quoted(f.name)), f.dataType).alias(f.name) for f in df.schema.fields])


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated rows without header or quoting, one line per row."""
    encoded = tsv_encode(df)
    encoded.select(F.concat_ws("\t", *[quoted(c) for c in encoded.columns]).alias("value")).write.text(path)

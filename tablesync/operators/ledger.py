"""Ledger of a copy: row count and checksums per key bucket, kept up to date by the passes that change the copy.

Checksums are sums over rows, so a pass needs only the rows it takes away and those it puts in: new sums = old sums - old rows
+ new rows. The ledger of a version always equals the bucket checksums of its rows; the copy itself is scanned once, when
the ledger begins. Verifying the copy then takes a scan of the source alone; only buckets that differ are opened.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.columns import cast_like, generated_names, resolve_key, select_as
from tablesync.functions.hashing import text_columns
from tablesync.model import Key
from tablesync.operators.verify import BUCKET, bucket_words, compare_keys, key_bucket

ROWS = "rows"


@dataclass(frozen=True)
class LedgerRules:
    """How a ledger is computed. ``bucket_of`` is an SQL expression in place of the hash bucket of the key."""

    buckets: int = 4096
    checksum: str = "xxhash64"
    float_scale: int | None = None
    bucket_of: str | None = None

    def document(self) -> dict[str, Any]:
        return asdict(self)


def ledger_columns(df: DataFrame, key: Key) -> list[str]:
    """The columns a ledger covers: key and all columns that the copy does not generate itself."""
    keys, generated = resolve_key(df, key), generated_names(df)
    return keys + [c for c in df.columns if c not in keys and c.lower() not in generated]


def _bucket(df: DataFrame, key: Key, rules: LedgerRules) -> Column:
    return F.expr(rules.bucket_of).cast("int") if rules.bucket_of else key_bucket(df, key, rules.buckets)


def bucket_sums(df: DataFrame, key: Key, rules: LedgerRules, sign: int = 1) -> DataFrame:
    """(bucket, rows, sum0, sum1, ...) of some rows; with ``sign=-1`` what they take away."""
    cols = ledger_columns(df, key)
    words = bucket_words(df, cols, text_columns(df, df, cols), rules.checksum, rules.float_scale)
    rows = df.select(_bucket(df, key, rules).alias(BUCKET), *[w.alias(f"sum{i}") for i, w in enumerate(words)])
    return rows.groupBy(BUCKET).agg(
        (F.count(F.lit(1)) * sign).alias(ROWS), *[(F.sum(f"sum{i}") * sign).alias(f"sum{i}") for i in range(len(words))]
    )


def added(parts: list[DataFrame]) -> DataFrame:
    """The sum of several ledgers or changes of a ledger. Buckets without rows go."""
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    sums = [c for c in total.columns if c != BUCKET]
    return total.groupBy(BUCKET).agg(*[F.sum(c).alias(c) for c in sums]).where(F.col(ROWS) != 0)


def as_copied(src: DataFrame, schema: T.StructType, columns: list[str]) -> DataFrame:
    """Source rows in the columns and types in which the copy holds them."""
    return cast_like(select_as(src, columns), T.StructType([schema[c] for c in columns]))


def compare_ledger(src_sums: DataFrame, ledger: DataFrame) -> DataFrame:
    """(bucket, equal) of all buckets of either side: one row a bucket, added up, no join."""
    sums = [c for c in ledger.columns if c != BUCKET]
    minus = ledger.select(BUCKET, *[(-F.col(c)).alias(c) for c in sums])
    both = src_sums.unionByName(minus).groupBy(BUCKET).agg(*[F.sum(c).alias(c) for c in sums])
    equal = F.lit(True)
    for c in sums:
        equal = equal & (F.col(c) == 0)
    return both.select(BUCKET, equal.alias("equal"))


def verify_ledger(src: DataFrame, copy: DataFrame, ledger: DataFrame, key: Key, rules: LedgerRules) -> DataFrame:
    """Every key that differs, ``(key, status)``: the source against the ledger, then rows of differing buckets only.

    The numbers of these buckets are a broadcast bounded by the number of buckets. Where buckets are an own expression
    there is no such bound, and Spark decides by the size of the join's side.
    """
    cols = ledger_columns(copy, key)
    source = as_copied(src, copy.schema, cols)
    bad = compare_ledger(bucket_sums(source, key, rules), ledger).where(~F.col("equal")).select(F.col(BUCKET).alias("__bucket"))
    if not rules.bucket_of:
        bad = F.broadcast(bad)
    copy = select_as(copy, cols)
    opened = [df.withColumn("__bucket", _bucket(df, key, rules)).join(bad, "__bucket", "left_semi").drop("__bucket") for df in (source, copy)]
    types = {k: copy.schema[k].dataType for k in resolve_key(copy, key)}
    return compare_keys(*opened, key, cols, text_columns(source, copy, cols), types, rules.float_scale, rules.checksum)


def same_columns(src: DataFrame, copy: DataFrame, key: Key) -> bool:
    """Whether the ledger covers exactly what a verification of both sides compares: the source has these columns and
    generates none of them."""
    covered = {c.lower() for c in ledger_columns(copy, key)}
    return covered <= {c.lower() for c in src.columns} and not generated_names(src) & covered


"""Row hashes, checksums of row hashes and the combined hash of a bounded row set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.columns import quoted, resolve_key
from tablesync.functions.text import key_text, md5_hex, text_of
from tablesync.model import Key

# One combined hash is built in a single task, so the number of rows behind it must stay bounded.
MAX_COMBINED_ROWS = 100_000


def row_text(df: DataFrame, columns: list[str] | None = None, float_scale: int | None = None) -> Column:
    """Columns in name order, each as ``name=value|``; NULL is written as ``NULL``."""
    parts: list[Column] = []
    for name in sorted(columns or df.columns):
        value = text_of(F.col(quoted(name)), df.schema[name].dataType, float_scale)
        parts += [F.lit(f"{name}="), F.coalesce(value, F.lit("NULL")), F.lit("|")]
    return F.concat(*parts)


def tagged_row_text(df: DataFrame, columns: list[str] | None = None, float_scale: int | None = None) -> Column:
    """Unambiguous form: ``name=value|``, with the length of texts as ``name=<length>:value|``, and ``name|`` for NULL.

    A value can neither imitate NULL nor the text of a neighbouring column.
    """
    free_text = (T.StringType, T.ArrayType, T.MapType, T.StructType)
    parts: list[Column] = []
    for name in sorted(columns or df.columns):
        dtype = df.schema[name].dataType
        value = text_of(F.col(quoted(name)), dtype, float_scale)
        head = [F.length(value).cast("string"), F.lit(":")] if isinstance(dtype, free_text) else []
        parts.append(F.coalesce(F.concat(F.lit(f"{name}="), *head, value, F.lit("|")), F.lit(f"{name}|")))
    return F.concat(*parts)


def row_hash(
    df: DataFrame, key: Key, columns: list[str] | None = None, float_scale: int | None = None
) -> DataFrame:
    """``(key columns, row_hash)`` for every row; a narrow projection without a shuffle."""
    text = row_text(df, columns, float_scale)
    return df.select(*[quoted(k) for k in resolve_key(df, key)], md5_hex(text).alias("row_hash"))


# Checksums add up words of at most 21 bits, so the sums are exact up to 2^42 rows in one group.
WORD_BITS = 21


def md5_words(hash_col: Column) -> list[Column]:
    """All 128 bits of an MD5 text as words of five hex digits, the last of two."""
    return [F.conv(F.substring(hash_col, at, 5), 16, 10).cast("bigint") for at in range(1, 33, 5)]


def value_hash(df: DataFrame, columns: list[str], as_text: set[str], float_scale: int | None = None) -> Column:
    """64-bit hash over the typed values.

    Several times cheaper than hashing text. NULL flags are part of the hash, since the hash function itself skips NULL.
    Columns in ``as_text`` are hashed by their canonical text, and with a ``float_scale`` so are floating-point columns.
    """
    values, flags = [], []
    for name in columns:
        c = F.col(quoted(name))
        dtype = df.schema[name].dataType
        scaled = float_scale is not None and isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType)
        values.append(text_of(c, dtype, float_scale) if name in as_text or scaled else c)
        flags.append(c.isNull())
    return F.xxhash64(*values, *flags)


def hash_words(h: Column) -> list[Column]:
    """All bits of a 64-bit hash as words."""
    return [F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << WORD_BITS) - 1)) for at in range(0, 64, WORD_BITS)]


def value_words(df: DataFrame, columns: list[str], as_text: set[str], float_scale: int | None = None) -> list[Column]:
    """All bits of :func:`value_hash`, as words."""
    return hash_words(value_hash(df, columns, as_text, float_scale))


def text_columns(src: DataFrame, dst: DataFrame, columns: list[str]) -> set[str]:
    """Columns to compare by text: nested ones and those whose types differ between the sides."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    out = set()
    for name in columns:
        a, b = src.schema[name].dataType, dst.schema[name].dataType
        if a.simpleString() != b.simpleString() or isinstance(a, nested):
            out.add(name)
    return out


def combined(order_text: Column, hash_col: Column) -> Column:
    """Aggregate: MD5 over the row hashes in key-text order, each followed by ``|``. NULL hashes are left out."""
    rows = F.array_sort(F.collect_list(F.when(hash_col.isNotNull(), F.struct(order_text.alias("k"), hash_col.alias("h")))))
    joined = F.array_join(F.transform(rows, lambda x: F.concat(x["h"], F.lit("|"))), "")
    return md5_hex(joined)


def combined_hash(df: DataFrame, key: Key, columns: list[str] | None = None, float_scale: int | None = None) -> DataFrame:
    """One row ``(rows, combined_hash)``. Use only on a bounded tail; see ``verify_full`` for whole tables."""
    keys = resolve_key(df, key)
    hashed = df.select(
        key_text(df, keys).alias("k"), md5_hex(row_text(df, columns, float_scale)).alias("h")
    ).limit(MAX_COMBINED_ROWS + 1)
    return hashed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.when(F.count(F.lit(1)) <= MAX_COMBINED_ROWS, combined(F.col("k"), F.col("h")))
        .otherwise(F.raise_error(F.lit(f"combined_hash takes at most {MAX_COMBINED_ROWS} rows; use verify_full")))
        .alias("combined_hash"),
    )

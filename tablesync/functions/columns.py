"""Plan-time column rules: lookup by name, projections, generated columns. No Spark job runs here."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.text import to_hex
from tablesync.model import GENERATED, IDENTITY, META_PREFIX, ROWVERSION, Key, key_list, quoted


class ColumnInfo(NamedTuple):
    name: str
    ordinal: int
    type: str
    generated: str | None


def column_info(df: DataFrame) -> list[ColumnInfo]:
    """Columns in ordinal order with type and generated kind (identity, rowversion or None)."""
    return [
        ColumnInfo(f.name, i, f.dataType.simpleString(), f.metadata.get(GENERATED))
        for i, f in enumerate(df.schema.fields, start=1)
    ]


def table_columns(spark: SparkSession, df: DataFrame) -> DataFrame:
    """:func:`column_info` as a DataFrame (one row per column of the table)."""
    return spark.createDataFrame(column_info(df), "name string, ordinal int, type string, generated string")


def mark_generated(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Flag a column as ``identity`` or ``rowversion``."""
    return df.withMetadata(find_column(df, name), {GENERATED: kind})


def mark_from_catalogue(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Flag the generated columns that a catalogue ``(column_name, generated)`` of this one table names.

    A table read through JDBC does not tell which columns the database fills in; its catalogue does. One row per column is
    read, at plan time. Columns that the table does not have, and rows without a kind, are left out.
    """
    marked = catalogue.where(F.col("generated").isNotNull()).select("column_name", "generated").distinct()
    for name, kind in marked.toLocalIterator():
        if kind not in (IDENTITY, ROWVERSION):
            raise ValueError(f"column {name!r} has the unknown generated kind {kind!r}")
        if has_column(df, name):
            df = mark_generated(df, name, kind)
    return df


def has_column(df: DataFrame, name: str) -> bool:
    return any(c.lower() == name.lower() for c in df.columns)


def find_column(df: DataFrame, name: str) -> str:
    """The spelling of ``name`` in ``df``; names are compared without case."""
    hits = [c for c in df.columns if c.lower() == name.lower()]
    if not hits:
        raise ValueError(f"column {name!r} not found; the table has {df.columns}")
    if len(hits) > 1:
        raise ValueError(f"column {name!r} is ambiguous: {hits} differ only by case")
    return hits[0]


def resolve_key(df: DataFrame, key: Key) -> list[str]:
    return [find_column(df, k) for k in key_list(key)]


def generated_names(df: DataFrame, *kinds: str) -> set[str]:
    """Lower-case names of generated columns; all kinds when none is given."""
    return {c.name.lower() for c in column_info(df) if c.generated and (not kinds or c.generated in kinds)}


def full_sync_columns(src: DataFrame, dst: DataFrame | None, key: Key) -> list[str]:
    """Key first, then the other source columns in source order without identity columns of the destination."""
    first = resolve_key(src, key)
    skip = {k.lower() for k in first} | (generated_names(dst, IDENTITY) if dst is not None else set())
    return first + [c for c in src.columns if c.lower() not in skip]


def aligned_columns(src: DataFrame, dst: DataFrame, key: Key) -> list[str]:
    """Key first, then destination columns (destination order and spelling) that exist in the source."""
    for k in key_list(key):
        find_column(src, k)
    first = [find_column(dst, k) if has_column(dst, k) else find_column(src, k) for k in key_list(key)]
    in_src = {c.lower() for c in src.columns}
    taken = {k.lower() for k in first}
    return first + [c for c in dst.columns if c.lower() in in_src and c.lower() not in taken]


def verify_columns(src: DataFrame, dst: DataFrame, key: Key) -> list[str]:
    """Destination columns that are generated on neither side; the key is always part of the list."""
    skip = generated_names(src) | generated_names(dst)
    cols = [c for c in dst.columns if c.lower() not in skip]
    if not cols:
        return []
    have = {c.lower() for c in cols}
    return [k for k in resolve_key(dst, key) if k.lower() not in have] + cols


def select_as(df: DataFrame, names: list[str]) -> DataFrame:
    """Project to ``names``, found without case and returned in the spelling given."""
    return df.select(*[F.col(quoted(find_column(df, n))).alias(n) for n in names])


def project_full_sync(src: DataFrame, dst: DataFrame | None, key: Key) -> DataFrame:
    return src.select(*[quoted(c) for c in full_sync_columns(src, dst, key)])


def project_aligned(src: DataFrame, dst: DataFrame, key: Key) -> DataFrame:
    return select_as(src, aligned_columns(src, dst, key))


def strip_metadata(df: DataFrame) -> DataFrame:
    """Drop change metadata columns."""
    return df.select(*[quoted(c) for c in df.columns if not c.startswith(META_PREFIX)])


def binary_to_hex(df: DataFrame) -> DataFrame:
    """Every binary column as lower-case hex text."""
    return df.select(*[
        to_hex(F.col(quoted(f.name))).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(quoted(f.name))
        for f in df.schema.fields
    ])


def cast_like(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; columns absent from ``df`` become NULL."""
    out = []
    for f in schema.fields:
        c = F.col(quoted(find_column(df, f.name))) if has_column(df, f.name) else F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name, metadata=f.metadata))
    return df.select(*out)


class Check(NamedTuple):
    check: str
    column: str | None
    ok: bool


def schema_checks(
    src: DataFrame | None, dst: DataFrame | None, key: Key, strict_types: bool = False
) -> list[Check]:
    """Source exists, key exists, every comparable destination column exists in the source.

    Extra source columns pass. Types are compared only with ``strict_types``.
    """
    checks = [Check("source_exists", None, src is not None)]
    if src is None:
        return checks
    checks += [Check("key_exists", k, has_column(src, k)) for k in key_list(key)]
    if dst is None:
        return checks
    skip = generated_names(src) | generated_names(dst)
    for c in dst.columns:
        if c.lower() not in skip:
            checks.append(Check("column_in_source", c, has_column(src, c)))
            if strict_types and has_column(src, c):
                same = src.schema[find_column(src, c)].dataType == dst.schema[c].dataType
                checks.append(Check("same_type", c, same))
    return checks


def validate_schema(
    spark: SparkSession, src: DataFrame | None, dst: DataFrame | None, key: Key, strict_types: bool = False
) -> DataFrame:
    """:func:`schema_checks` as a DataFrame ``(check, column, ok)``."""
    return spark.createDataFrame(schema_checks(src, dst, key, strict_types), "check string, column string, ok boolean")

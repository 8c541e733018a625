"""Canonical text of values: the base of row hashes and of the text export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.model import quoted


def to_hex(c: Column) -> Column:
    """Lower-case hex text of a binary column."""
    return F.lower(F.hex(c))


def from_hex(c: Column) -> Column:
    """Binary value of hex text."""
    return F.unhex(c)


def md5_hex(c: Column) -> Column:
    """MD5 as lower-case hex text."""
    return F.md5(c)


def _timestamp_text(c: Column, dtype: T.DataType) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.ffffff``; instants are written in UTC whatever the session zone is."""
    if isinstance(dtype, T.TimestampType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        c = F.timestamp_add("MICROSECOND", F.unix_micros(c), epoch)
    text = c.cast("string")  # no trailing zeros in the fraction, no session zone
    fixed = F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8),
        F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"),
    )
    return F.when(F.substring(text, 5, 1) == "-", fixed).otherwise(text)  # years of four digits


def _float_text(c: Column, dtype: T.DataType, scale: int | None) -> Column:
    """Shortest exact text, or fixed decimals where ``scale`` is given (needed to compare with other engines)."""
    exact = (c + F.lit(0.0).cast(dtype)).cast("string")  # -0.0 and 0.0 are the same value
    if scale is None:
        return exact
    decimals = [c.try_cast(T.DecimalType(p, scale)).cast("string") for p in (18, 38)]  # 18 digits are the fast case
    return F.coalesce(*decimals, exact)


def _nested(c: Column, dtype: T.DataType, scale: int | None) -> Column:
    """Arrays, maps and structs with all leaves as canonical text; map entries in key order."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _nested(x, dtype.elementType, scale))
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.struct(
                _nested(e["key"], dtype.keyType, scale).alias("key"),
                _nested(e["value"], dtype.valueType, scale).alias("value"),
            ),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.StructType):
        fields = [_nested(c.getField(f.name), f.dataType, scale).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return text_of(c, dtype, scale)


def text_of(c: Column, dtype: T.DataType, float_scale: int | None = None) -> Column:
    """Canonical text of one value; NULL stays NULL."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BinaryType):
        return to_hex(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return _timestamp_text(c, dtype)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _float_text(c, dtype, float_scale)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(_nested(c, dtype, float_scale), {"ignoreNullFields": "false"})
    return c.cast("string")


def key_text(df: DataFrame, key: list[str]) -> Column:
    """A key as one text value; the parts of a composite key are joined with ``|``."""
    parts = [text_of(F.col(quoted(k)), df.schema[k].dataType) for k in key]
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def export_text(c: Column, dtype: T.DataType) -> Column:
    """Value rules of the delimited text export; NULL becomes the empty string."""
    if isinstance(dtype, T.StringType):
        text = F.translate(c, "\t\n\r", "   ")
    elif isinstance(dtype, T.BooleanType):
        text = c.cast("int").cast("string")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.translate(F.substring(_timestamp_text(c, dtype), 1, 23), "T", " ")
    else:
        text = F.translate(text_of(c, dtype), "\t\n\r", "   ")
    return F.coalesce(text, F.lit(""))

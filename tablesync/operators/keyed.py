"""Key-set operators: read, delete and replace rows by key, and apply changes by operation code.

All functions are lazy. Key sets are DataFrames and stay distributed. Without ``broadcast`` the join strategy is left to
Catalyst and AQE (size statistics decide, skewed partitions are split); ``broadcast=True`` is for callers that have
measured the key set, see :func:`measure_keys`; ``merge=True`` asks for a sort-merge join, whose output is partitioned by key.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.columns import cast_like, quoted, resolve_key, strip_metadata
from tablesync.model import (
    DEFAULT_FEED,
    OP_BEFORE,
    OP_DELETE,
    FeedNames,
    Key,
    key_list,
)

# A key set up to this measured size is sent to every executor; beyond it the join is a shuffle join.
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 48


# Key types whose smallest and largest value go through the driver unchanged.
_EXACT = (T.IntegralType, T.StringType, T.DecimalType, T.DateType, T.BinaryType)


class KeyStats(NamedTuple):
    """Measure of a key set: number, size in a broadcast table, smallest and largest leading key (None if unknown).

    ``type`` is the type whose order the smallest and largest key follow.
    """

    keys: int
    bytes: int
    low: Any = None
    high: Any = None
    type: str | None = None

    def fits(self, limit: int = BROADCAST_BYTES) -> bool:
        return self.bytes <= limit


def key_bytes(df: DataFrame, key: Key) -> Column:
    """Aggregate: estimated memory of a key set in a broadcast table."""
    width: Column = F.lit(ROW_OVERHEAD)
    for k in resolve_key(df, key):
        dtype = df.schema[k].dataType
        if isinstance(dtype, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(quoted(k))), F.lit(0))
        else:
            width = width + F.lit(16)
    return F.coalesce(F.sum(width.cast("bigint")), F.lit(0))


def measure_keys(keys: DataFrame, key: Key) -> KeyStats:
    """Measure a key set (an action; the set should be a written table, not a long plan)."""
    return stats_of(keys, key, keys.agg(*key_stats(keys, key)).head().asDict())


def key_stats(df: DataFrame, key: Key) -> list[Column]:
    lead = resolve_key(df, key)[0]
    known = isinstance(df.schema[lead].dataType, _EXACT)
    c = F.col(quoted(lead)) if known else F.lit(None).cast("int")
    return [
        F.count(F.lit(1)).alias("n"), key_bytes(df, key).alias("b"), F.min(c).alias("low"), F.max(c).alias("high"),
    ]


def stats_of(keys: DataFrame, key: Key, found: dict[str, Any]) -> KeyStats:
    lead = keys.schema[resolve_key(keys, key)[0]].dataType.simpleString()
    return KeyStats(found.get("n") or 0, found.get("b") or 0, found.get("low"), found.get("high"), lead)


def not_null_key(df: DataFrame, key: Key) -> Column:
    cond = F.lit(True)
    for k in resolve_key(df, key):
        cond = cond & F.col(quoted(k)).isNotNull()
    return cond


def changed_keys(changes: DataFrame, key: Key) -> DataFrame:
    """Distinct keys of a change set. NULL keys are dropped. A key changed many times is reduced before the shuffle."""
    keys = resolve_key(changes, key)
    return changes.where(not_null_key(changes, key)).select(*[quoted(k) for k in keys]).distinct()


def typed_keys(keys: DataFrame, table: DataFrame, key: Key) -> DataFrame:
    """Keys under the names and types of ``table``, so that the join compares plain columns of equal type.

    A key that cannot be read as the type of the table is an error in every ANSI mode: it must not get lost as NULL.
    """
    out = []
    for k in key_list(key):
        have, want = resolve_key(keys, k)[0], resolve_key(table, k)[0]
        c, dtype = F.col(quoted(have)), table.schema[want].dataType
        if keys.schema[have].dataType != dtype:
            wrong = F.raise_error(F.concat(F.lit(f"key {want} is no {dtype.simpleString()}: "), c.cast("string")))
            c = F.coalesce(c.try_cast(dtype), wrong.cast(dtype))
        out.append(c.alias(want))
    return keys.where(not_null_key(keys, key)).select(*out)


def _key_join(table: DataFrame, keys: DataFrame, key: Key, how: str, broadcast: bool, merge: bool) -> DataFrame:
    right = typed_keys(keys, table, key)
    if broadcast:
        right = F.broadcast(right)
    elif merge:
        right = right.hint("merge")
    return table.join(right, resolve_key(table, key), how).select(*[quoted(c) for c in table.columns])


def read_by_keys(
    table: DataFrame,
    keys: DataFrame,
    key: Key,
    broadcast: bool = False,
    merge: bool = False,
    stats: KeyStats | None = None,
) -> DataFrame:
    """Current rows whose key is in the set; keys absent from the table yield nothing.

    With the measure of the set, its smallest and largest key become a filter of the scan, which skips the row groups
    outside of that range (and is pushed to a remote database). Texts and bytes get no such filter: the order of a
    database's collation is not the order of bytes, and a range in the wrong order loses rows.
    """
    return _key_join(_within(table, key, stats), keys, key, "left_semi", broadcast, merge)


def _within(table: DataFrame, key: Key, stats: KeyStats | None) -> DataFrame:
    lead = resolve_key(table, key)[0]
    dtype = table.schema[lead].dataType
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return table
    if stats is None or stats.low is None or stats.type != dtype.simpleString():
        return table
    low, high = (F.lit(v).cast(dtype) for v in (stats.low, stats.high))
    return table.where(F.col(quoted(lead)).between(low, high))


def delete_by_keys(
    target: DataFrame, keys: DataFrame, key: Key, broadcast: bool = False, merge: bool = False
) -> DataFrame:
    """Rows whose key is not in the set. Rows with a NULL key stay."""
    return _key_join(target, keys, key, "left_anti", broadcast, merge)


def replace_by_keys(
    target: DataFrame, source: DataFrame, keys: DataFrame, key: Key, broadcast: bool = False
) -> DataFrame:
    """Delete the keys from the target, then add the current source rows of these keys.

    Keys gone from the source stay deleted. Applying the same keys again changes nothing. The result has the columns of
    the target; target columns unknown to the source are NULL in the new rows.
    """
    kept = delete_by_keys(target, keys, key, broadcast)
    fresh = cast_like(read_by_keys(source, keys, key, broadcast), target.schema)
    return kept.unionByName(fresh)


def latest_changes(changes: DataFrame, key: Key, names: FeedNames = DEFAULT_FEED) -> DataFrame:
    """The last change of every key, before-images aside.

    ``max_by`` combines on the map side, so one key with a third of all changes does not end in a single task as it
    would with a window over the key.
    """
    keys = resolve_key(changes, key)
    after = changes.where(not_null_key(changes, key) & (F.col(quoted(names.operation)) != OP_BEFORE))
    rest = [c for c in changes.columns if c not in keys]
    order = F.struct(*[F.col(quoted(c)) for c in (names.lsn, names.seqval, names.operation)])
    last = F.max_by(F.struct(*[F.col(quoted(c)) for c in rest]), order).alias("__last")
    picked = after.groupBy(*[quoted(k) for k in keys]).agg(last)
    by_name = {c: F.col(quoted(c)) if c in keys else F.col("__last").getField(c).alias(c) for c in changes.columns}
    return picked.select(*[by_name[c] for c in changes.columns])


def put_rows(latest: DataFrame, schema: T.StructType, names: FeedNames = DEFAULT_FEED) -> DataFrame:
    """Rows that inserts and after-images put into a table of ``schema``."""
    put = latest.where(F.col(quoted(names.operation)) != OP_DELETE).drop(*names)
    return cast_like(strip_metadata(put), schema)


def apply_latest(
    target: DataFrame, latest: DataFrame, key: Key, names: FeedNames = DEFAULT_FEED, broadcast: bool = False
) -> DataFrame:
    """Apply one change per key: deletes remove the row, inserts and after-images put the row of the change."""
    return delete_by_keys(target, latest, key, broadcast).unionByName(put_rows(latest, target.schema, names))


def apply_ops(target: DataFrame, changes: DataFrame, key: Key, names: FeedNames = DEFAULT_FEED) -> DataFrame:
    """Op-aware apply of a change set (insert, update, delete by operation code)."""
    return apply_latest(target, latest_changes(changes, key, names), key, names)

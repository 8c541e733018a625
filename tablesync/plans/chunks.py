"""Full sync in chunks beside a moving source: resumable, and bounded by watermarks of the change feed.

The key space is cut into chunks. For each one the newest position of the feed is read before its rows are copied (low watermark)
and again afterwards (high watermark). A row of the chunk whose key changed in between may have been read in either state, so
it is left out; its change lies behind the position frozen before the first chunk, from which change sync goes on, and brings
its current row. What a chunk wrote is noted in the sync state, so that a run that failed continues with the next chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.columns import quoted, resolve_key
from tablesync.model import DEFAULT_FEED, FeedNames, Key
from tablesync.operators.changes import lsn_window
from tablesync.operators.keyed import changed_keys, typed_keys
from tablesync.sinks.snapshot import SnapshotTarget

#: Types whose quantiles Spark estimates in one aggregation; other keys are cut by their hash.
_RANGED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Relative error of the quantiles: one part in so many. Chunks need not be equal.
ACCURACY = 10_000


@dataclass(frozen=True)
class Chunks:
    """A cut of the key space into ``n`` chunks: by ranges of the leading key column (``bounds`` as text), or by hash."""

    n: int
    bounds: tuple[str, ...] | None

    @classmethod
    def cut(cls, source: DataFrame, key: Key, n: int) -> Chunks:
        """Ranges of about equal numbers of rows, so that a chunk is a filter of the scan; by hash for other key types."""
        lead = resolve_key(source, key)[0]
        if not isinstance(source.schema[lead].dataType, _RANGED):
            return cls(n, None)
        if n < 2:
            return cls(1, ())
        cuts = F.percentile_approx(F.col(quoted(lead)), F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(ACCURACY))
        found = source.agg(F.array_sort(F.array_distinct(cuts)).alias("cuts"))
        bounds = tuple(found.select(F.transform("cuts", lambda c: c.cast("string"))).head()[0] or ())
        return cls(len(bounds) + 1, bounds)

    def part(self, df: DataFrame, key: Key, i: int) -> Column:
        """Which rows belong to chunk ``i``; every row belongs to one. NULL keys go with the first."""
        keys = resolve_key(df, key)
        if self.bounds is None:
            return F.pmod(F.xxhash64(*[F.col(quoted(k)) for k in keys]), F.lit(self.n)) == i
        lead, dtype = F.col(quoted(keys[0])), df.schema[keys[0]].dataType
        at = [F.lit(b).cast(dtype) for b in self.bounds]
        if not at:
            return F.lit(True)
        if i == 0:
            return lead.isNull() | (lead < at[0])
        return (lead >= at[i - 1]) & (lead < at[i]) if i < len(at) else lead >= at[-1]


def copy_chunk(
    target: SnapshotTarget,
    rows: DataFrame,
    key: Key,
    chunks: Chunks,
    number: int,
    watermark: Callable[[], str | None] | None,
    feed: Callable[[], DataFrame] | None,
    names: FeedNames = DEFAULT_FEED,
) -> dict[str, Any]:
    """Copy one chunk into an unpublished part of the target; returns what the state keeps of it."""
    low = watermark() if watermark else None
    part = target.stage_part(rows.where(chunks.part(rows, key, number)))
    high = watermark() if watermark else None
    if high is not None and high != low:
        keys = typed_keys(changed_keys(lsn_window(feed(), low, high, names), key), rows, key)
        part["dropped"] = target.stage_dropped(keys.where(chunks.part(keys, key, number)))
    return part

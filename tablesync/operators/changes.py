"""Change-feed operators: log-position windows, bounds, summaries."""

from __future__ import annotations

import os.path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.columns import quoted, resolve_key, select_as
from tablesync.functions.text import to_hex
from tablesync.model import DEFAULT_FEED, FeedNames, Key
from tablesync.operators.keyed import not_null_key, read_by_keys

Position = str | Column


def _is_binary(feed: DataFrame, names: FeedNames) -> bool:
    return isinstance(feed.schema[names.lsn].dataType, T.BinaryType)


def lsn_text(feed: DataFrame, names: FeedNames = DEFAULT_FEED) -> Column:
    """Log position as hex text: lower-case from a binary column, and in the spelling of the feed from a text column."""
    c = F.col(quoted(names.lsn))
    return to_hex(c) if _is_binary(feed, names) else c


def as_stored(feed: DataFrame, position: Position, names: FeedNames) -> Column:
    """A hex position in the type of the feed column: the comparison stays a plain one that reaches the scan.

    A position of a text feed must have the spelling of the feed (case, prefix), as those that :func:`lsn_text` returns.
    """
    if not _is_binary(feed, names):
        return F.lit(position) if isinstance(position, str) else position
    return F.unhex(F.lit(position.lower().removeprefix("0x")) if isinstance(position, str) else position)


def lsn_window(
    changes: DataFrame,
    from_lsn: Position | None,
    to_lsn: Position | None = None,
    names: FeedNames = DEFAULT_FEED,
) -> DataFrame:
    """Changes strictly after ``from_lsn`` and, if given, up to and including ``to_lsn``."""
    lsn = F.col(quoted(names.lsn))
    if from_lsn is not None:
        changes = changes.where(lsn > as_stored(changes, from_lsn, names))
    if to_lsn is not None:
        changes = changes.where(lsn <= as_stored(changes, to_lsn, names))
    return changes


def read_changes(
    feed: DataFrame,
    from_lsn: Position | None,
    to_lsn: Position | None = None,
    names: FeedNames = DEFAULT_FEED,
    ordered: bool = False,
) -> DataFrame:
    """Change scan; all operations incl. before-images. ``ordered`` sorts by position, then sequence.

    The order of changes is carried by their columns, so nothing downstream needs the (global) sort.
    """
    window = lsn_window(feed, from_lsn, to_lsn, names)
    return window.orderBy(quoted(names.lsn), quoted(names.seqval)) if ordered else window


def lsn_bounds(feed: DataFrame, names: FeedNames = DEFAULT_FEED) -> DataFrame:
    """One row ``(min_lsn, max_lsn)``; both NULL for an empty feed."""
    lsn = lsn_text(feed, names)
    return feed.agg(F.min(lsn).alias("min_lsn"), F.max(lsn).alias("max_lsn"))


def change_summary(changes: DataFrame, key: Key, names: FeedNames = DEFAULT_FEED) -> DataFrame:
    """One row: changes, distinct keys, max position, rows per operation.

    Grouped by key first with plain counters, which combine on the map side; the second step adds up one row per key.
    """
    op = F.col(quoted(names.operation))
    keyed = changes.groupBy(not_null_key(changes, key).alias("__has_key"), *[quoted(k) for k in resolve_key(changes, key)]).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(op == code).alias(f"__op{code}") for code in (1, 2, 3, 4)],
    )
    counts = keyed.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("changes"),
        F.count_if(F.col("__has_key")).alias("distinct_keys"),
        *[
            F.coalesce(F.sum(f"__op{code}"), F.lit(0)).alias(name)
            for code, name in ((1, "deletes"), (2, "inserts"), (3, "before_images"), (4, "after_images"))
        ],
    )
    max_lsn = changes.agg(F.max(lsn_text(changes, names)).alias("max_lsn")).scalar()
    return counts.withColumn("max_lsn", max_lsn)


def apply_counts(target: DataFrame, source: DataFrame, keys: DataFrame, key: Key) -> DataFrame:
    """One row: keys in the set, target rows they delete, source rows they import.

    Both tables go through one join, as their key columns only.
    """
    names = resolve_key(target, key)
    sides = [
        select_as(df, names).withColumn("__is_target", F.lit(is_target)) for df, is_target in ((target, True), (source, False))
    ]
    hits = read_by_keys(sides[0].unionByName(sides[1]), keys, names)
    counts = hits.agg(
        F.count_if(F.col("__is_target")).alias("deleted"), F.count_if(~F.col("__is_target")).alias("imported")
    )
    total = keys.agg(F.count(F.lit(1))).scalar()
    return counts.select(total.alias("keys"), "deleted", "imported")


def bootstrap_window(
    feed: DataFrame,
    last_lsn: str | None,
    mode: str = "parity",
    names: FeedNames = DEFAULT_FEED,
) -> DataFrame:
    """The window of a mapping that may have no stored position yet.

    ``parity`` starts strictly after the first position of the feed, so the changes at that first position are skipped.
    ``all`` takes the feed from its start.
    """
    if mode not in ("parity", "all"):
        raise ValueError(f"unknown bootstrap mode {mode!r}")
    if last_lsn is not None:
        return lsn_window(feed, last_lsn, names=names)
    if mode == "all":
        return feed
    first = feed.agg(F.min(lsn_text(feed, names)).alias("first")).scalar()
    return lsn_window(feed, first, names=names)


def bounded_position(
    feed: DataFrame, from_lsn: Position | None, positions: int, names: FeedNames = DEFAULT_FEED
) -> DataFrame:
    """One row ``(to_lsn)``: the last of the next ``positions`` distinct positions; bounds the size of one pass.

    Nothing is lost: the changes beyond it belong to the next pass.
    """
    window = lsn_window(feed, from_lsn, names=names)
    nxt = window.select(lsn_text(window, names).alias("p")).distinct().orderBy("p").limit(positions)
    return nxt.agg(F.max("p").alias("to_lsn"))


#: Hex digits of a position that one step of :func:`bounded_changes` tells apart: at most 4096 groups.
STEP_DIGITS = 3


def bounded_changes(
    feed: DataFrame, from_lsn: Position | None, changes: int, names: FeedNames = DEFAULT_FEED, digits: int = STEP_DIGITS
) -> str | None:
    """The last position up to which a pass that starts after ``from_lsn`` holds at most ``changes`` changes.

    The first position alone where it has more; None where nothing follows. Nothing is lost: the changes beyond belong to the next
    pass.

    The cut is found by descending the digits of the positions: changes are counted by the next digits (a bounded number of
    groups, added up before the shuffle), a running sum finds the group in which the bound is crossed, and the next step
    looks into that group only. So neither positions nor changes are sorted, and a position with a third of all changes
    is one counter. A step reads the position column alone; a feed in hex text gets the prefix as a filter of its scan.
    """
    if changes < 1:
        raise ValueError("a pass needs room for at least one change")
    window = lsn_window(feed, from_lsn, names=names)
    position = lsn_text(window, names)
    ends = window.agg(F.min(position), F.max(position)).head()
    if ends[0] is None:
        return None
    prefix = os.path.commonprefix(ends)
    room, included = changes, None
    while True:
        some = window.where(position.startswith(prefix)) if prefix else window
        group = F.substring(position, len(prefix) + 1, digits)
        counts = some.groupBy(group.alias("digits")).agg(
            F.count(F.lit(1)).alias("n"), F.min(position).alias("first"), F.max(position).alias("last")
        )
        # One window over a bounded number of groups.
        running = counts.withColumn("sum", F.sum("n").over(Window.orderBy("digits")))
        beyond = F.col("sum") > room
        crossing = F.min_by(F.struct("digits", "first", "last", (F.col("sum") - F.col("n")).alias("before")), F.when(beyond, F.col("digits")))
        found = running.agg(F.max(F.when(~beyond, F.col("last"))).alias("fits"), crossing.alias("crossing")).head()
        included = found["fits"] or included
        if found["crossing"] is None:
            return included
        at = found["crossing"]
        if at["first"] == at["last"]:
            return included or at["last"]
        prefix, room = prefix + at["digits"], room - at["before"]

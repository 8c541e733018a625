"""Continuous change sync with Structured Streaming.

The change feed is a stream, the target a :class:`SnapshotTarget` (or, in replace mode, a :class:`JdbcTarget`). ``replace`` mode only takes the changed keys from the
stream and re-reads the current source rows, so neither order nor repetition of changes matters. ``ops`` mode takes the rows
from the changes themselves and keeps the last applied position of every key (deletes included) in a second target, so
changes that arrive late are dropped.

At the boundary of a batch a stream looks whether a full sync of its table is requested. If so the batch waits, the full
sync runs, and its position is handed over: changes up to there are part of the copy and are left out from then on. A batch is
checked before it is published, as a pass of change sync is; what fails a check or the full sync stops the stream
before the batch counts, so that a restart delivers it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablesync.functions.columns import has_column, quoted, resolve_key
from tablesync.model import CDC, DEFAULT_FEED, SUCCESS, WARNING, FeedNames, Key, Mapping, key_list
from tablesync.operators.changes import as_stored, lsn_window
from tablesync.operators.keyed import latest_changes, measure_keys, read_by_keys
from tablesync.plans.jobs import GuardFailed, SyncEngine, check_arrival
from tablesync.sinks.control_store import ControlStore, utc_now
from tablesync.sinks.files import stage, stage_keys
from tablesync.sinks.jdbc import JdbcTarget
from tablesync.sinks.snapshot import SnapshotTarget, Staged
from tablesync.sources.folders import Folder, scratch


def replace_batch(
    target: SnapshotTarget | JdbcTarget, source: DataFrame, batch: DataFrame, key: Key, properties: dict
) -> Staged:
    """One micro-batch in replace mode. The key set is written first: the batch is read once."""
    with scratch(target.spark, "batch-keys") as folder:
        keys, stats = stage_keys(batch, key, folder, target.spark)
        return _published(target, target.stage_replace(source, keys, properties, stats))


def _published(target: SnapshotTarget | JdbcTarget, staged: Staged) -> Staged:
    """Check what the staged rows of a batch became, then publish them. A batch without a key publishes nothing."""
    check_arrival(staged, target.staged_rows(staged) - staged.kept)
    if staged.keys:
        target.publish(staged)
    return staged


def newer_changes(latest: DataFrame, positions: DataFrame, key: Key, names: FeedNames = DEFAULT_FEED) -> DataFrame:
    """Changes that come after the last applied position of their key, or whose key has none yet."""
    keys = resolve_key(latest, key)
    seen = positions.select(*[quoted(k) for k in keys], F.struct("__lsn", "__seqval").alias("__seen"))
    now = F.struct(F.col(quoted(names.lsn)).alias("__lsn"), F.col(quoted(names.seqval)).alias("__seqval"))
    joined = latest.join(seen, keys, "left").where(F.col("__seen").isNull() | (now > F.col("__seen")))
    return joined.select(*[quoted(c) for c in latest.columns])


def known_positions(positions: SnapshotTarget, latest: DataFrame) -> DataFrame:
    """Last applied positions of the keys of a batch, a written table with one row per key.

    The keys of a batch are few against all keys ever changed: where their measure allows it they are broadcast, so that the
    table of positions is filtered where it lies, and so are the few rows found.
    """
    keys = latest.select(*[quoted(k) for k in resolve_key(latest, positions.key)])
    stats = measure_keys(keys, positions.key)
    small = stats.fits(positions.broadcast_bytes)
    found = read_by_keys(positions.read(), keys, positions.key, small, not small, stats)
    return F.broadcast(found) if small else found


def ops_batch(
    target: SnapshotTarget,
    positions: SnapshotTarget,
    batch: DataFrame,
    key: Key,
    names: FeedNames,
    properties: dict,
) -> Staged:
    """One micro-batch in ops mode.

    The target is published before the positions: if the batch is repeated after a failure in between, the same changes are
    applied again with the same result.
    """
    keys = key_list(key)
    with scratch(target.spark, "batch-changes") as folder:
        latest = stage(latest_changes(batch, key, names), f"{folder}/latest", target.spark)
        if positions.exists():
            latest = stage(newer_changes(latest, known_positions(positions, latest), key, names), f"{folder}/newer", target.spark)
        staged = _published(target, target.stage_ops(latest, names, properties))
        applied = latest.select(
            *[quoted(k) for k in keys],
            F.col(quoted(names.lsn)).alias("__lsn"),
            F.col(quoted(names.seqval)).alias("__seqval"),
        )
        if positions.exists():
            positions.replace_by_keys(applied, applied.select(*[quoted(k) for k in keys]))
        else:
            positions.overwrite(applied)
        return staged


def expire_positions(positions: SnapshotTarget, horizon: str) -> int:
    """Forget the positions of keys whose last change lies before the horizon; returns how many were forgotten.

    The table is written anew without them, in one pass, and only if there are any.
    """
    known = positions.read()
    old = F.col("__lsn") < (F.unhex(F.lit(horizon)) if dict(known.dtypes)["__lsn"] == "binary" else F.lit(horizon))
    gone = known.where(old).count()
    if gone:
        positions.overwrite(known.where(~old))
    return gone


def stream_sync(
    feed_stream: DataFrame,
    source_reader: Callable[[], DataFrame],
    target: SnapshotTarget | JdbcTarget,
    checkpoint: str,
    mode: str = "replace",
    trigger: str | None = "10 seconds",
    names: FeedNames = DEFAULT_FEED,
    store: ControlStore | None = None,
    mapping_id: int | None = None,
    flow_id: int | None = None,
    engine: SyncEngine | None = None,
    mapping: Mapping | None = None,
    horizon: Callable[[], str | None] | None = None,
    expire_every: int = 50,
) -> StreamingQuery:
    """Start the sync. ``trigger`` is a processing-time interval; None processes what is there and stops.

    Batches never overlap, and a long one delays the next. A batch is delivered at least once: its number is published
    together with its rows, and a batch that was published already is not applied a second time. The position to resume
    from is the stream checkpoint. Log rows are keyed by the batch.

    In ops mode ``horizon`` gives the position before which no change can arrive any more, the low position of the feed say.
    Changes before it are left out, as the positions of their keys may be forgotten: every ``expire_every`` batches those
    before the horizon are, deletes included, so what is kept is bounded by the keys that changed since.

    With ``engine`` and ``mapping``, full syncs that are requested run between batches (see above), also the first one of a
    target that does not exist yet; the store of the engine takes the log rows.
    """
    if mode not in ("replace", "ops"):
        raise ValueError(f"unknown mode {mode!r}")
    for k in target.key:
        if not has_column(feed_stream, k):
            raise GuardFailed(f"Key column {k} is not in the change feed")
    if engine is not None:
        if mapping is None:
            raise ValueError("an engine needs the mapping of the stream")
        store, mapping_id, flow_id = engine.store, mapping.mapping_id, mapping.flow_id
    if mode == "ops":
        # Only batches of this stream read the positions, one at a time, so a few versions are enough.
        positions = SnapshotTarget(
            target.spark, f"{target.root}/positions", target.key, target.buckets, target.broadcast_bytes,
            count_deleted=False, keep_versions=20,
        )

    def apply(batch: DataFrame, batch_id: int) -> None:
        done = target.properties() if target.exists() else {}
        # The id in the checkpoint: a new checkpoint at the same place is another stream, whose batches count from 0.
        stream = Folder(target.spark, checkpoint).read_json("metadata")["id"]
        if done.get("stream") == stream and done.get("batch", -1) >= batch_id and mode == "replace":
            return
        properties = {"stream": stream, "batch": batch_id}
        if engine is not None:
            if engine.full_sync_requested(mapping):
                result = engine.full_sync(mapping)
                if result.status != SUCCESS:
                    raise GuardFailed(f"Full sync before batch {batch_id} failed: {result.message}")
            batch = lsn_window(batch, store.position(mapping_id), names=names)
        low = horizon() if horizon is not None and mode == "ops" else None
        if low is not None:
            batch = batch.where(F.col(quoted(names.lsn)) >= as_stored(batch, low, names))
        if mode == "replace":
            staged = replace_batch(target, source_reader(), batch, target.key, properties)
        else:
            staged = ops_batch(target, positions, batch, target.key, names, properties)
            # After the target and the positions of this batch are published: a repetition finds the same rows to forget.
            if low is not None and (batch_id + 1) % expire_every == 0:
                expire_positions(positions, low)
        if store is not None and mapping_id is not None:
            text = f"Batch {batch_id}: {staged.keys} keys, {staged.deleted} deleted, {staged.fresh} imported"
            status = SUCCESS
            if not staged.keys and not batch.isEmpty():
                text, status = f"Batch {batch_id}: changes without a key value", WARNING
            store.append_logs(
                [{
                    "flow_id": flow_id, "mapping_id": mapping_id, "log_type": CDC, "log_message": text,
                    "status": status, "records_count": staged.fresh,
                }],
                run=f"stream-{mapping_id}-{batch_id}",
            )
            store.update(mapping_id, last_cdc_sync_at=utc_now())

    writer = feed_stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()

"""Jobs: full sync, change sync, verification, and the runs over many mappings.

A job is driver control flow around lazy plans. Order inside a job: write, check, publish the target, then store the
position, then log. A failure at any point leaves the position where it was, and the next run repeats the pass; replacing
keys by their current source rows makes the repetition harmless.
"""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.columns import (
    cast_like,
    generated_names,
    has_column,
    project_full_sync,
    schema_checks,
    verify_columns,
)
from tablesync.model import (
    CDC,
    CONNECTION,
    DEFAULT_FEED,
    ERROR,
    FAILED,
    FULL_SYNC,
    IDENTITY,
    INFO,
    SUCCESS,
    SYNC,
    VERIFICATION,
    WARNING,
    ZERO_LSN,
    FeedNames,
    Mapping,
    key_list,
)
from tablesync.operators.changes import bounded_changes, bounded_position, lsn_bounds, lsn_text, lsn_window
from tablesync.operators.control import MESSAGE_HEAD, enabled_mappings, verifiable_mappings, with_states
from tablesync.operators.ledger import same_columns, verify_ledger
from tablesync.operators.reconcile import verify_sets
from tablesync.operators.verify import SAMPLE_KEYS, mismatch_sample, tail_summary, verify_full, verify_tail_rows
from tablesync.plans.chunks import Chunks, copy_chunk
from tablesync.sinks.control_store import ControlStore, utc_now
from tablesync.sinks.files import stage, stage_keys
from tablesync.sinks.jdbc import JdbcTarget
from tablesync.sinks.snapshot import SnapshotTarget, Staged
from tablesync.sources.folders import scratch
from tablesync.sources.tables import read_remote_by_keys

log = logging.getLogger("tablesync")


@dataclass(frozen=True)
class Endpoints:
    """Where the tables of a mapping are; the functions are called once per pass and return the current data.

    ``remote`` marks a source behind JDBC: small key sets are sent to it as a filter.
    """

    source: Callable[[], DataFrame | None]
    feed: Callable[[], DataFrame | None]
    target: SnapshotTarget | JdbcTarget
    remote: bool = False


@dataclass(frozen=True)
class Options:
    """Job options. 5 parallel tables, 10 tail rows."""

    parallelism: int = 5
    verification_rows: int = 10
    # parity: the changes at the very first position are skipped on a bootstrap without full sync; all: they are read
    bootstrap: str = "all"
    max_positions: int | None = None
    # a pass holds at most so many changes, unless one position alone has more
    max_changes: int | None = None
    feed_names: FeedNames = DEFAULT_FEED
    float_scale: int | None = None
    # Seconds that the jobs of one mapping may take in a run over mappings; then its Spark jobs are cancelled, no others.
    # What the driver does without Spark is not interrupted.
    time_limit: float | None = None
    # Snapshot targets: copy in so many chunks beside the change feed; a full sync that failed goes on at the next chunk
    chunks: int | None = None
    # Whole-table verification by set reconciliation (sets) or by bucket checksums (buckets)
    whole_verification: str = "sets"
    # JDBC targets: load the table itself in a full sync; half the writing, but readers see it fill up
    in_place: bool = False


@dataclass(frozen=True)
class RunResult:
    mapping_id: int
    log_type: str
    status: str
    message: str
    records: int | None = None
    duration_ms: int | None = None
    deleted: int | None = None
    changes: int = 0
    keys: int = 0
    mismatches: int = 0
    compared: int = 0


class GuardFailed(RuntimeError):
    """A data check failed; nothing was published."""


def check_arrival(staged: Staged, arrived: int) -> bool:
    """Whether as many rows arrived as were exported; an error if rows were exported and none arrived."""
    if staged.fresh > 0 and arrived <= 0:
        raise GuardFailed(f"{staged.fresh} rows exported, none imported")
    return arrived == staged.fresh


class SyncEngine:
    """Runs mappings. ``locate`` gives the endpoints of a mapping; credentials live there, not in control tables."""

    def __init__(
        self,
        spark: SparkSession,
        store: ControlStore,
        locate: Callable[[Mapping], Endpoints],
        options: Options | None = None,
    ):
        self.spark, self.store, self.locate, self.options = spark, store, locate, options or Options()
        self._running: set[int] = set()
        self._limits = threading.local()
        self._lock = threading.Lock()

    # ---- single jobs ---------------------------------------------------------------------------------------------

    def full_sync(self, mapping: Mapping) -> RunResult:
        """Replace the whole target by the source; then continue from the position frozen before the copy."""
        return self._guarded(mapping, FULL_SYNC, self._full_sync)

    def _full_sync(self, mapping: Mapping, say) -> RunResult:
        ends, names = self.locate(mapping), self.options.feed_names
        say(INFO, "Copying the whole table")
        served, frozen = self._request(mapping), None
        if mapping.cdc_enabled:
            feed = ends.feed()
            if feed is None:
                say(WARNING, "No change feed found")
            else:
                frozen = lsn_bounds(feed, names).head()["max_lsn"] or ZERO_LSN
        target, rows = ends.target, self._exported(mapping, ends, say)
        if self.options.chunks and isinstance(target, SnapshotTarget):
            staged, frozen = self._in_chunks(mapping, ends, rows, frozen, served, say)
            arrived = sum(part["rows"] for part in self.store.state(mapping.mapping_id)["snapshot"]["parts"])
            return self._published(mapping, target, staged, arrived, frozen, served, say)
        if self.options.in_place and isinstance(target, JdbcTarget):
            exported, arrived = target.truncate_and_load(rows), target.read().count()
            if exported != arrived:
                say(WARNING, f"{exported} rows were read, but the target holds {arrived}")
            return self._published(mapping, target, None, arrived, frozen, served, say)
        staged = target.stage_overwrite(rows)
        return self._published(mapping, target, staged, target.staged_rows(staged), frozen, served, say)

    def _exported(self, mapping: Mapping, ends: Endpoints, say) -> DataFrame:
        """The rows of the source as the target takes them, after the schema check."""
        source, target = self._source(mapping, ends, say), ends.target
        old = target.read() if target.exists() else None
        failed = [c for c in schema_checks(source, old, mapping.key) if not c.ok]
        if failed:
            raise GuardFailed(f"Schema checks not passed: {[(c.check, c.column) for c in failed]}")
        # Only a database numbers identity columns itself; files must get the values of the source.
        numbered = old if isinstance(target, JdbcTarget) else None
        rows = project_full_sync(source, numbered, mapping.key)
        if old is not None:
            filled = generated_names(numbered, IDENTITY) - {c.lower() for c in rows.columns} if numbered is not None else set()
            rows = cast_like(rows, T.StructType([f for f in old.schema.fields if f.name.lower() not in filled]))
        return rows

    def _in_chunks(self, mapping: Mapping, ends: Endpoints, rows: DataFrame, frozen: str | None, served: str | None, say):
        """Copy the source chunk by chunk; returns the staged version and the position to go on from.

        What is done is noted in the state after every chunk. A run that finds notes of an unfinished one goes on where
        it ended if the change feed still reaches back to its start; without a feed it begins anew.
        """
        target, names = ends.target, self.options.feed_names
        made_for = {"request": served, "schema": rows.schema.jsonValue(), "buckets": target.buckets, "wanted": self.options.chunks}
        notes = self.store.state(mapping.mapping_id).get("snapshot") or {}
        if not (notes and frozen and notes["made_for"] == made_for and self._reaches(ends, notes["frozen"]) and target.has_parts(notes["parts"])):
            chunks = Chunks.cut(rows, mapping.key, self.options.chunks)
            notes = {"made_for": made_for, "frozen": frozen, "n": chunks.n, "bounds": chunks.bounds, "parts": []}
            self.store.update(mapping.mapping_id, snapshot=notes)
        elif notes["parts"]:
            say(INFO, f"Full sync goes on with chunk {len(notes['parts']) + 1} of {notes['n']}")
        chunks = Chunks(notes["n"], None if notes["bounds"] is None else tuple(notes["bounds"]))
        watermark = None
        if frozen:
            watermark = lambda: lsn_bounds(ends.feed(), names).head()["max_lsn"]
        while len(notes["parts"]) < chunks.n:
            number = len(notes["parts"])
            part = copy_chunk(target, rows, mapping.key, chunks, number, watermark, ends.feed, names)
            notes = {**notes, "parts": [*notes["parts"], part]}
            self.store.update(mapping.mapping_id, snapshot=notes)
            if number + 1 < chunks.n:
                rows = self._exported(mapping, ends, say)
        return target.stage_parts(rows.schema, notes["parts"]), notes["frozen"]

    def _reaches(self, ends: Endpoints, position: str) -> bool:
        """Whether the feed still holds everything after a position."""
        feed = ends.feed()
        first = lsn_bounds(feed, self.options.feed_names).head()["min_lsn"] if feed is not None else None
        return position == ZERO_LSN or first is None or first <= position

    def _published(self, mapping: Mapping, target, staged: Staged | None, arrived: int, frozen, served, say) -> RunResult:
        """Check the counts, publish the staged version (None: loaded in place) and store position and flags."""
        exported = staged.fresh if staged else arrived
        if exported > 0 and arrived != exported:
            say(WARNING, f"{exported} rows were read, but the target holds {arrived}")
        if staged:
            target.publish(staged)
        now, still = utc_now(), None if self._request(mapping) != served else False
        self.store.update(
            mapping.mapping_id, is_full_sync=still, last_cdc_lsn=frozen, last_full_sync_at=now, last_connected_at=now, snapshot={}
        )
        return self._done(mapping, FULL_SYNC, f"Copied the whole table: {arrived} rows", records=arrived)

    def cdc_sync(self, mapping: Mapping) -> RunResult:
        """Bring the keys that changed since the stored position up to date."""
        return self._guarded(mapping, CDC, self._cdc_sync)

    def _start(self, mapping: Mapping, feed: DataFrame) -> str | None:
        """Position the pass starts after; None where there is nothing to start from yet."""
        stored = self.store.position(mapping.mapping_id) or mapping.last_cdc_lsn
        if stored is not None:
            return stored
        if self.options.bootstrap == "all":
            return ZERO_LSN
        first = lsn_bounds(feed, self.options.feed_names).head()["min_lsn"]
        if first is not None:
            self.store.update(mapping.mapping_id, last_cdc_lsn=first)
        return first

    def _window(self, mapping: Mapping, feed: DataFrame) -> tuple[DataFrame, str | None, int]:
        """The changes of this pass, the position of its end (frozen here) and their number."""
        names = self.options.feed_names
        start = self._start(mapping, feed)
        if start is None:
            return feed, None, 0
        end = None
        if self.options.max_positions:
            end = bounded_position(feed, start, self.options.max_positions, names).head()["to_lsn"]
        if self.options.max_changes:
            # Within the positions allowed; None where there are none.
            end = bounded_changes(lsn_window(feed, start, end, names), None, self.options.max_changes, names) or end
        window = lsn_window(feed, start, end, names)
        found = window.agg(F.max(lsn_text(window, names)).alias("end"), F.count(F.lit(1)).alias("n")).head()
        end = found["end"]
        return (window if end is None else lsn_window(window, None, end, names)), end, found["n"]

    def _cdc_sync(self, mapping: Mapping, say) -> RunResult:
        ends = self.locate(mapping)
        feed = ends.feed()
        if feed is None:
            say(WARNING, "No change feed found")
            return self._done(mapping, CDC, "Change sync skipped", status=WARNING)
        window, end, changes = self._window(mapping, feed)
        if end is None:
            return self._done(mapping, CDC, "No changes", records=0)
        for k in key_list(mapping.key):
            if not has_column(feed, k):
                raise GuardFailed(f"Key column {k} is not in the change feed")
        target, source = ends.target, self._source(mapping, ends, say)
        if source is None:
            raise GuardFailed("Source table not found")
        with scratch(self.spark, "keys") as folder:
            # Written once: the key set is read several times below and must not change in between.
            keys, stats = stage_keys(window, mapping.key, folder)
            if ends.remote:
                source = read_remote_by_keys(source, keys, mapping.key)
            staged = target.stage_replace(source, keys, stats=stats)
        arrived = target.staged_rows(staged) - staged.kept
        if not check_arrival(staged, arrived):
            say(WARNING, f"{staged.fresh} rows were read, but the target holds {arrived}")
        if staged.keys == 0:
            say(WARNING, f"{changes} changes without a key value")
        else:
            target.publish(staged)
        now = utc_now()
        self.store.update(mapping.mapping_id, last_cdc_lsn=end, last_cdc_sync_at=now, last_connected_at=now)
        deleted = "uncounted" if staged.deleted is None else staged.deleted
        message = f"Change sync completed, {changes} changes, {staged.keys} keys, {deleted} deleted, {arrived} imported"
        return self._done(
            mapping, CDC, message, records=arrived, deleted=staged.deleted, changes=changes, keys=staged.keys
        )

    def verify(self, mapping: Mapping) -> RunResult:
        """Compare the last rows of the target with the source."""
        return self._guarded(mapping, VERIFICATION, self._verify)

    def _verify(self, mapping: Mapping, say) -> RunResult:
        ends, n = self.locate(mapping), self.options.verification_rows
        src, dst = self._source(mapping, ends, say), ends.target.read()
        if src is None:
            raise GuardFailed("Source table not found")
        if not verify_columns(src, dst, mapping.key):
            return self._done(mapping, VERIFICATION, "No columns to verify", status=INFO)
        with scratch(self.spark, "tail") as folder:
            # At most n rows; written so that summary and sample describe the same reading of both tables.
            rows = stage(verify_tail_rows(src, dst, mapping.key, n, self.options.float_scale), folder)
            found = tail_summary(rows, mapping.key).head()
            sample = mismatch_sample(rows, mapping.key).collect()
        if found["compared"] + found["mismatches"] == 0:
            return self._done(mapping, VERIFICATION, "Destination is empty, nothing to verify", status=INFO)
        counts = {"records": found["compared"], "compared": found["compared"]}
        if found["match"]:
            return self._done(mapping, VERIFICATION, f"Last {n} records match", **counts)
        text = (
            f"{found['mismatches']} mismatches, {found['compared']} compared in the last {n} records; "
            f"keys: {self._shown(mapping, sample)}"
        )
        return self._done(mapping, VERIFICATION, text, status=FAILED, mismatches=found["mismatches"], **counts)

    def verify_whole(self, mapping: Mapping) -> RunResult:
        """Compare the whole target with the source; finds rows missing on either side, too."""
        return self._guarded(mapping, VERIFICATION, self._verify_whole)

    def _verify_whole(self, mapping: Mapping, say) -> RunResult:
        ends = self.locate(mapping)
        src, dst = self._source(mapping, ends, say), ends.target.read()
        if src is None:
            raise GuardFailed("Source table not found")
        if not verify_columns(src, dst, mapping.key):
            return self._done(mapping, VERIFICATION, "No columns to verify", status=INFO)
        with scratch(self.spark, "differences") as folder:
            scale, kept = self.options.float_scale, self._ledger(ends.target, src, dst, mapping)
            if kept is not None:
                compared = verify_ledger(src, dst, kept[0], mapping.key, kept[1])
            elif self.options.whole_verification == "sets":
                compared = verify_sets(src, dst, mapping.key, scale, work=f"{folder}/work")
            else:
                compared = verify_full(src, dst, mapping.key, float_scale=scale)
            found = stage(compared, f"{folder}/found")
            counts = {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
            sample = found.orderBy(*found.columns).limit(SAMPLE_KEYS).collect()
        if not counts:
            return self._done(mapping, VERIFICATION, "All records match", mismatches=0)
        parts = ", ".join(f"{n} {status}" for status, n in sorted(counts.items()))
        text = f"Tables differ: {parts}; keys: {self._shown(mapping, sample)}"
        return self._done(mapping, VERIFICATION, text, status=FAILED, mismatches=sum(counts.values()))

    @staticmethod
    def _ledger(target, src: DataFrame, dst: DataFrame, mapping: Mapping):
        """Ledger and rules of a copy that keeps one for all columns that are compared."""
        kept = target.ledger() if isinstance(target, SnapshotTarget) else None
        return kept if kept and same_columns(src, dst, mapping.key) else None

    @staticmethod
    def _shown(mapping: Mapping, sample) -> str:
        return ", ".join("|".join(str(r[k]) for k in key_list(mapping.key)) for r in sample)

    # ---- over mappings -------------------------------------------------------------------------------------------

    def sync_mapping(self, mapping: Mapping) -> list[RunResult]:
        """Full sync where requested, followed by change sync if it succeeded; change sync otherwise.

        The request flag is read again at the start, so change sync waits while a full sync is requested.
        """
        if not self._enter(mapping.mapping_id):
            return [RunResult(mapping.mapping_id, SYNC, INFO, "Already in progress")]
        try:
            results = []
            if self.full_sync_requested(mapping):
                results.append(self.full_sync(mapping))
                if results[0].status != SUCCESS:
                    return results
            if mapping.cdc_enabled:
                results.append(self.cdc_sync(mapping))
            return results
        finally:
            self._leave(mapping.mapping_id)

    def full_sync_requested(self, mapping: Mapping) -> bool:
        return bool(self.store.state(mapping.mapping_id).get("is_full_sync", mapping.is_full_sync))

    def request_full_sync(self, mapping_id: int) -> None:
        """Ask for a full sync; one asked for while another is running is not lost."""
        self.store.update(mapping_id, is_full_sync=True, request=uuid.uuid4().hex)

    def _request(self, mapping: Mapping) -> str | None:
        return self.store.state(mapping.mapping_id).get("request")

    def sync_all(self, mappings: Iterable[Mapping]) -> list[RunResult]:
        """Every mapping on its own; the failure of one does not touch the others."""
        return [r for results in self._parallel(self.sync_mapping, mappings) for r in results]

    def verify_all(self, mappings: Iterable[Mapping]) -> list[RunResult]:
        """Verify the mappings that are not being synchronised at the moment."""
        with self._lock:
            running = set(self._running)
        return self._parallel(self.verify, [m for m in mappings if m.mapping_id not in running])

    def running(self) -> DataFrame:
        with self._lock:
            rows = [(i,) for i in sorted(self._running)]
        return self.spark.createDataFrame(rows, "mapping_id int")

    def verifiable(self, mappings: DataFrame) -> DataFrame:
        return verifiable_mappings(mappings, self.running())

    def _parallel(self, job, mappings: Iterable[Mapping]):
        with ThreadPoolExecutor(self.options.parallelism) as pool:
            # Wrapped one by one: what a wrapper hands on is one set of properties, which its threads would share.
            started = [pool.submit(inheritable_thread_target(self.spark)(partial(self._by_itself, job)), m) for m in mappings]
            return [s.result() for s in started]

    def _by_itself(self, job, mapping: Mapping):
        """Run the jobs of a mapping in a scheduler pool of its own, with one time limit for all of them.

        Pools share the executors evenly where ``spark.scheduler.mode`` is FAIR, so a mapping with many tasks does not keep
        the others waiting.
        """
        pool = "spark.scheduler.pool"
        before = self.spark.sparkContext.getLocalProperty(pool)
        self.spark.sparkContext.setLocalProperty(pool, f"mapping-{mapping.mapping_id}")
        self._limits.end = time.monotonic() + self.options.time_limit if self.options.time_limit else None
        try:
            return job(mapping)
        finally:
            self._limits.end = None
            self.spark.sparkContext.setLocalProperty(pool, before)

    @contextmanager
    def _limited(self) -> Iterator[threading.Event]:
        """Cancel what this thread runs in Spark once the time of its mapping is over; tells whether that happened.

        Spark jobs carry a tag of this run, by which they alone are cancelled. Those that the driver starts after the limit
        are cancelled as well, until the block is left; log and state are written outside of it.
        """
        late, done, end = threading.Event(), threading.Event(), getattr(self._limits, "end", None)
        if end is None:
            yield late
            return
        context, tag = self.spark.sparkContext, f"tablesync-{uuid.uuid4().hex}"

        def watch() -> None:
            wait = max(end - time.monotonic(), 0)
            while not done.wait(wait):
                late.set()
                context.cancelJobsWithTag(tag)
                wait = 1.0

        watcher = threading.Thread(target=watch, daemon=True)
        context.addJobTag(tag)
        try:
            watcher.start()
            yield late
        finally:
            done.set()
            watcher.join()
            context.removeJobTag(tag)

    # ---- bookkeeping ---------------------------------------------------------------------------------------------

    def _enter(self, mapping_id: int) -> bool:
        with self._lock:
            if mapping_id in self._running:
                return False
            self._running.add(mapping_id)
            return True

    def _leave(self, mapping_id: int) -> None:
        with self._lock:
            self._running.discard(mapping_id)

    def _source(self, mapping: Mapping, ends: Endpoints, say) -> DataFrame | None:
        try:
            return ends.source()
        except Exception as error:
            say(ERROR, f"Source cannot be opened: {type(error).__name__}", log_type=CONNECTION)
            raise

    def _done(self, mapping: Mapping, log_type: str, message: str, status: str = SUCCESS, **numbers) -> RunResult:
        return RunResult(mapping.mapping_id, log_type, status, message, **numbers)

    def _guarded(self, mapping: Mapping, log_type: str, job) -> RunResult:
        """Run one job, turn any failure into an ERROR result and write the log rows of the run."""
        begun = time.monotonic()
        rows: list[dict] = []

        def say(status: str, text: str, records=None, duration=None, log_type: str = log_type) -> None:
            rows.append({
                "flow_id": mapping.flow_id, "mapping_id": mapping.mapping_id, "log_type": log_type,
                "log_message": message_head(mapping) + text, "status": status,
                "records_count": records, "duration_ms": duration,
            })

        late = threading.Event()
        try:
            with self._limited() as late:
                result = job(mapping, say)
        except Exception as error:  # one mapping must not stop the others
            log.exception("%s of mapping %s failed", log_type, mapping.mapping_id)
            text = f"{type(error).__name__}: {error}"
            if late.is_set():
                text = f"Cancelled after the limit of {self.options.time_limit:g} seconds"
            result = RunResult(mapping.mapping_id, log_type, ERROR, text)
        took = int((time.monotonic() - begun) * 1000)
        say(result.status, result.message, result.records, took)
        self.store.append_logs(rows)
        return RunResult(**{**result.__dict__, "duration_ms": took})


def message_head(m: Mapping) -> str:
    return MESSAGE_HEAD % (
        m.flow_name, m.source_table,
        m.source_database, m.source_schema, m.source_table,
        m.dest_database, m.dest_schema, m.dest_table,
    )


def load_mappings(mappings: DataFrame, flows: DataFrame, states: DataFrame | None = None) -> list[Mapping]:
    """The enabled mappings as job inputs. Control rows only: one per table to keep in step.

    ``states`` (of a :class:`ControlStore`) is put over the mappings, which may be older than the last run.
    """
    if states is not None:
        mappings = with_states(mappings, states)
    rows = enabled_mappings(mappings, flows).orderBy("mapping_id").select(
        "mapping_id", "flow_id", "flow_name",
        "source_database", "source_schema", "source_table", "dest_database", "dest_schema", "dest_table",
        F.split("primary_key_column", ",").alias("key"), "is_full_sync", "cdc_enabled", "last_cdc_lsn",
    )
    return [
        Mapping(**{**r.asDict(), "key": tuple(k.strip() for k in r["key"])}) for r in rows.toLocalIterator()
    ]

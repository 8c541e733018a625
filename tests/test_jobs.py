import datetime
import threading

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablesync.functions.columns import mark_generated
from tablesync.model import ERROR, FAILED, INFO, SUCCESS, WARNING, FeedNames, Mapping, TableSpec
from tablesync.plans import jobs
from tablesync.plans.jobs import Endpoints, Options, SyncEngine, load_mappings
from tablesync.sinks.control_store import ControlStore
from tablesync.sinks.files import cluster_by_key, stage, write_tsv
from tablesync.sinks.snapshot import SnapshotTarget
from tablesync.sources.folders import Folder
from tablesync.sources.tables import read_table, resolve_feed, table_exists

NAMES = FeedNames("lsn", "seqval", "op")
FEED = "lsn string, seqval string, op int, id int, v string"


def lsn(n):
    return f"{n:020x}"


class World:
    """A source, its change feed and a target, with a mapping over them."""

    def __init__(self, spark, folder, mapping_id=1, **options):
        self.spark, self.now, self.entries = spark, {1: "a", 2: "b"}, []
        self.store = ControlStore(spark, folder("control"))
        self.target = SnapshotTarget(spark, folder("target"), "id", 2)
        self.options = Options(feed_names=NAMES, **options)
        self.engine = SyncEngine(spark, self.store, lambda m: Endpoints(self.source, self.feed, self.target), self.options)
        self.mapping = mapping(mapping_id)
        self.on_source = None

    def source(self):
        df = self.spark.createDataFrame(list(self.now.items()), "id int, v string")
        if self.on_source:
            self.on_source()
        return df

    def feed(self):
        return self.spark.createDataFrame(self.entries, FEED)

    def change(self, position, key, value):
        """Put (or with None delete) a row and leave a change behind."""
        op = 1 if value is None else 4 if key in self.now else 2
        if value is None:
            self.now.pop(key, None)
        else:
            self.now[key] = value
        self.entries.append((lsn(position), lsn(len(self.entries)), op, key, value))

    def in_step(self):
        return rows(self.target.read()) == sorted(self.now.items())

    def position(self):
        return self.store.position(self.mapping.mapping_id)

    def statuses(self):
        found = self.store.logs().orderBy("log_id").collect()
        return [(r["log_type"], r["status"]) for r in found]


def mapping(mapping_id=1, **changes):
    base = dict(
        mapping_id=mapping_id, flow_id=7, flow_name="f", source_database="s", source_schema="dbo", source_table="t",
        dest_database="d", dest_schema="dbo", dest_table="t2", key=("id",), is_full_sync=True, cdc_enabled=True,
    )
    return Mapping(**{**base, **changes})


@pytest.fixture
def world(spark, folder):
    return World(spark, folder)


def test_full_sync_then_changes(world):
    world.change(1, 3, "c")
    results = world.engine.sync_mapping(world.mapping)
    assert [r.status for r in results] == [SUCCESS, SUCCESS]
    assert results[0].records == 3 and world.in_step() and world.position() == lsn(1)
    state = world.store.states().first()
    assert state["is_full_sync"] is False and state["last_full_sync_at"] and state["last_connected_at"]
    world.change(2, 1, None)
    world.change(2, 2, "bb")
    world.change(3, 2, "bbb")
    results = world.engine.sync_mapping(world.mapping)
    assert len(results) == 1 and world.in_step() and world.position() == lsn(3)
    assert (results[0].changes, results[0].keys, results[0].deleted, results[0].records) == (3, 2, 2, 1)
    assert world.engine.sync_mapping(world.mapping)[0].message == "No changes"


def test_log_rows(world):
    world.engine.sync_mapping(world.mapping)
    entries = world.store.logs().orderBy("log_id").collect()
    assert [(r["log_type"], r["status"], r["records_count"]) for r in entries] == [
        ("FULL_SYNC", INFO, None), ("FULL_SYNC", SUCCESS, 2), ("CDC", SUCCESS, 0),
    ]
    assert entries[1]["log_message"] == (
        "Flow 'f': Table mapping 't' (s.dbo.t -> d.dbo.t2) - Copied the whole table: 2 rows"
    )
    assert entries[1]["duration_ms"] > 0 and entries[0]["flow_id"] == 7


def test_changes_during_the_copy_are_not_lost(world):
    """The position is frozen before the source is read; a change after that is replayed."""
    world.change(1, 3, "c")
    late = []

    def meanwhile():
        if not late:
            late.append(1)
            world.change(2, 4, "d")  # not part of the rows read by this copy

    world.on_source = meanwhile
    assert world.engine.full_sync(world.mapping).status == SUCCESS
    assert not world.in_step() and world.position() == lsn(1)
    world.engine.cdc_sync(world.mapping)
    assert world.in_step()


def test_empty_feed_at_the_copy_means_from_the_start(world):
    world.engine.full_sync(world.mapping)
    assert world.position() == lsn(0)
    world.change(1, 5, "first")
    world.engine.cdc_sync(world.mapping)
    assert world.in_step()


def test_failed_full_sync_changes_nothing_and_is_retried(world):
    world.engine.sync_mapping(world.mapping)
    world.engine.request_full_sync(1)
    position = world.position()
    good = world.source

    def broken():
        return good().withColumn("v", F.when(F.col("id") == 1, F.raise_error(F.lit("boom"))).otherwise("x"))

    world.source = broken
    results = world.engine.sync_mapping(world.mapping)
    assert [(r.log_type, r.status) for r in results] == [("FULL_SYNC", ERROR)]  # no change sync after a failure
    assert world.in_step() and world.position() == position
    assert world.engine.full_sync_requested(world.mapping)
    world.source = good
    world.now[9] = "z"
    assert world.engine.sync_mapping(world.mapping)[0].status == SUCCESS
    assert world.in_step() and not world.engine.full_sync_requested(world.mapping)


def test_a_request_during_a_full_sync_is_not_lost(world):
    world.engine.request_full_sync(1)
    world.on_source = lambda: world.engine.request_full_sync(1)
    assert world.engine.full_sync(world.mapping).status == SUCCESS
    assert world.engine.full_sync_requested(world.mapping)
    world.on_source = None
    assert world.engine.full_sync(world.mapping).status == SUCCESS
    assert not world.engine.full_sync_requested(world.mapping)


def test_unreachable_source_is_a_connection_error(world):
    def gone():
        raise OSError("no route")

    world.source = gone
    assert world.engine.full_sync(world.mapping).status == ERROR
    assert ("CONNECTION", ERROR) in world.statuses()


def test_schema_validation_stops_the_full_sync(world, spark):
    world.target.overwrite(spark.createDataFrame([(1, "a", 5)], "id int, v string, gone int"))
    result = world.engine.full_sync(world.mapping)
    assert result.status == ERROR and "gone" in result.message
    assert world.target.read().count() == 1


def test_full_sync_into_an_existing_table_goes_by_name(world, spark):
    dst = spark.createDataFrame([("z", 9, 1)], "V string, ID int, seq int")
    world.target.overwrite(mark_generated(dst, "seq", "identity"))
    assert world.engine.full_sync(world.mapping).status == SUCCESS
    assert world.target.read().columns == ["V", "ID", "seq"]
    assert rows(world.target.read()) == [("a", 1, None), ("b", 2, None)]


def test_failure_between_apply_and_state_is_replayed(world, monkeypatch):
    world.engine.full_sync(world.mapping)
    world.change(1, 1, None)
    world.change(2, 3, "c")
    before = world.position()
    with monkeypatch.context() as m:
        m.setattr(world.store, "update", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        assert world.engine.cdc_sync(world.mapping).status == ERROR
    assert world.position() == before and world.in_step()
    world.change(3, 1, "back")
    assert world.engine.cdc_sync(world.mapping).status == SUCCESS
    assert world.in_step() and world.position() == lsn(3)


def test_nothing_imported_stops_the_pass(world, monkeypatch):
    world.engine.full_sync(world.mapping)
    world.change(1, 3, "c")
    monkeypatch.setattr(world.target, "staged_rows", lambda staged: 0)
    result = world.engine.cdc_sync(world.mapping)
    assert result.status == ERROR and "none imported" in result.message
    assert world.position() == lsn(0) and world.target.read().count() == 2


def test_count_mismatch_is_a_warning(world, monkeypatch):
    monkeypatch.setattr(world.target, "staged_rows", lambda staged: 1)
    assert world.engine.full_sync(world.mapping).status == SUCCESS
    assert ("FULL_SYNC", WARNING) in world.statuses()


def test_changes_without_keys_are_reported_and_passed(world):
    world.engine.full_sync(world.mapping)
    world.entries.append((lsn(5), lsn(1), 4, None, "x"))
    assert world.engine.cdc_sync(world.mapping).status == SUCCESS
    assert ("CDC", WARNING) in world.statuses() and world.position() == lsn(5) and world.in_step()


def test_feed_without_the_key_column(world):
    world.engine.full_sync(world.mapping)
    world.change(1, 3, "c")
    good = world.feed
    world.feed = lambda: good().drop("id")
    assert "not in the change feed" in world.engine.cdc_sync(world.mapping).message
    assert world.position() == lsn(0)


def test_no_feed_is_a_warning(world):
    world.engine.full_sync(world.mapping)
    world.feed = lambda: None
    assert world.engine.cdc_sync(world.mapping).status == WARNING


@pytest.mark.parametrize("mode,found", [("parity", [(1, "a"), (2, "b"), (4, "d")]), ("all", [(1, "a"), (2, "b"), (3, "c"), (4, "d")])])
def test_bootstrap_without_a_position(spark, folder, mode, found):
    world = World(spark, folder, bootstrap=mode)
    world.target.overwrite(world.source())
    world.change(1, 3, "c")
    world.change(2, 4, "d")
    world.engine.cdc_sync(world.mapping)
    assert rows(world.target.read()) == found and world.position() == lsn(2)


def test_bounded_passes_reach_the_same_end(spark, folder):
    world = World(spark, folder, max_positions=2)
    world.target.overwrite(world.source())
    for n in range(1, 6):
        world.change(n, n, f"v{n}")
    seen = []
    while world.engine.cdc_sync(world.mapping).keys:
        seen.append(world.position())
    assert seen == [lsn(2), lsn(4), lsn(5)] and world.in_step()


def test_verification(world):
    world.engine.full_sync(world.mapping)
    result = world.engine.verify(world.mapping)
    assert (result.status, result.compared, result.mismatches) == (SUCCESS, 2, 0)
    world.now[2] = "other"
    world.now.pop(1)
    result = world.engine.verify(world.mapping)
    assert (result.status, result.compared, result.mismatches) == (FAILED, 1, 2)
    assert "keys: 2, 1" in result.message
    world.target.overwrite(world.target.read().limit(0))
    assert world.engine.verify(world.mapping).status == INFO


def test_whole_table_verification(world):
    world.engine.full_sync(world.mapping)
    assert world.engine.verify_whole(world.mapping).status == SUCCESS
    world.now = {2: "other", 3: "c"}
    result = world.engine.verify_whole(world.mapping)
    assert (result.status, result.mismatches) == (FAILED, 3)
    assert "1 different, 1 missing_in_dst, 1 missing_in_src; keys: 1, 2, 3" in result.message


def test_remote_source_gets_the_keys_as_a_filter(world, monkeypatch):
    seen = []

    def locate(m):
        return Endpoints(world.source, world.feed, world.target, remote=True)

    original = jobs.read_remote_by_keys
    monkeypatch.setattr(jobs, "read_remote_by_keys", lambda *a: seen.append(1) or original(*a))
    world.engine.locate = locate
    world.engine.full_sync(world.mapping)
    world.change(1, 2, "bb")
    world.change(2, 1, None)
    assert world.engine.cdc_sync(world.mapping).status == SUCCESS
    assert seen and world.in_step()


def test_failures_do_not_touch_other_mappings(spark, folder):
    worlds = {i: World(spark, folder, mapping_id=i) for i in (1, 2, 3)}
    worlds[2].source = lambda: (_ for _ in ()).throw(RuntimeError("down"))
    store = ControlStore(spark, folder("shared"))

    def locate(m):
        w = worlds[m.mapping_id]
        return Endpoints(lambda: w.source(), w.feed, w.target)

    engine = SyncEngine(spark, store, locate, Options(parallelism=3, feed_names=NAMES))
    results = engine.sync_all([w.mapping for w in worlds.values()])
    by_id = {i: [r.status for r in results if r.mapping_id == i] for i in worlds}
    assert by_id == {1: [SUCCESS] * 2, 2: [ERROR], 3: [SUCCESS] * 2}
    assert worlds[1].in_step() and worlds[3].in_step()
    assert store.logs().select("log_id").distinct().count() == store.logs().count()
    checked = engine.verify_all([worlds[1].mapping, worlds[3].mapping])
    assert [r.status for r in checked] == [SUCCESS, SUCCESS]


def test_a_running_mapping_is_neither_started_twice_nor_verified(world, spark):
    inside, go = threading.Event(), threading.Event()

    def wait():
        inside.set()
        go.wait(60)

    world.on_source = wait
    worker = threading.Thread(target=world.engine.sync_mapping, args=(world.mapping,))
    worker.start()
    try:
        assert inside.wait(60)
        world.on_source = None
        second = world.engine.sync_mapping(world.mapping)
        assert [r.message for r in second] == ["Already in progress"]
        assert world.engine.verify_all([world.mapping]) == []
        all_ids = spark.createDataFrame([(1,), (2,)], "mapping_id int")
        assert [r[0] for r in world.engine.verifiable(all_ids).collect()] == [2]
    finally:
        go.set()
        worker.join()
    assert world.engine.running().count() == 0 and world.in_step()


def test_state_versions_and_log_runs(spark, folder):
    store = ControlStore(spark, folder(), keep=2)
    for n in range(4):
        store.update(5, last_cdc_lsn=lsn(n), last_cdc_sync_at=None)
    assert store.state(5) == {"last_cdc_lsn": lsn(3)}
    assert len(store._document(5).numbers()) == 2
    entry = {"log_type": "CDC", "log_message": "m", "status": "SUCCESS"}
    for _ in range(2):
        store.append_logs([entry], run="batch-1")
    store.append_logs([])
    assert store.logs().count() == 1
    assert store.logs().first()["created_at"].year >= 2024


def test_merged_logs_lose_and_repeat_nothing(spark, folder, monkeypatch):
    store = ControlStore(spark, folder())
    entry = {"log_type": "CDC", "log_message": "m", "status": "SUCCESS"}
    assert store.merge_logs() == 0
    for run in ("a", "b"):
        store.append_logs([entry, entry], run=run)
    with monkeypatch.context() as m:
        m.setattr(Folder, "delete", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.merge_logs()  # published, but the runs are still there
    assert store.logs().count() == 4
    store.append_logs([entry], run="c")
    store.append_logs([entry, entry], run="b")  # a repeated run that is merged already
    assert store.logs().count() == 5
    assert store.merge_logs() == 1
    assert store.logs().count() == 5 and store.merge_logs() == 0


def test_load_mappings(spark, folder):
    flows = spark.createDataFrame([(7, "f", True), (8, "g", False)], "flow_id int, flow_name string, is_enabled boolean")
    mappings = spark.createDataFrame(
        [(1, 7, "s", "dbo", "t", "d", "dbo", "t2", "id", True, True, True, None),
         (2, 7, "s", "dbo", "u", "d", "dbo", "u2", "a, b", False, True, True, lsn(4)),
         (3, 8, "s", "dbo", "v", "d", "dbo", "v2", "id", False, True, True, None)],
        "mapping_id int, flow_id int, source_database string, source_schema string, source_table string, dest_database string,"
        " dest_schema string, dest_table string, primary_key_column string, is_full_sync boolean, is_enabled boolean,"
        " cdc_enabled boolean, last_cdc_lsn string",
    )
    first, second = load_mappings(mappings, flows)
    assert first == mapping(1)
    assert second.key == ("a", "b") and second.last_cdc_lsn == lsn(4)
    store = ControlStore(spark, folder())
    store.update(1, is_full_sync=False, last_cdc_lsn=lsn(9))
    first, second = load_mappings(mappings, flows, store.states())
    assert (first.is_full_sync, first.last_cdc_lsn) == (False, lsn(9))
    assert second.last_cdc_lsn == lsn(4)


def test_table_specs(spark, folder):
    path = folder("table")
    spark.range(5).withColumnRenamed("id", "ID").withColumn("v", F.lit(1)).write.parquet(path)
    spec = TableSpec("parquet", path)
    assert read_table(spark, spec, ["id"]).columns == ["ID"]
    assert table_exists(spark, spec) and not table_exists(spark, TableSpec("parquet", path + "x"))
    assert resolve_feed(spark, None) is None
    assert resolve_feed(spark, TableSpec("parquet", path + "x")) is None
    assert resolve_feed(spark, spec) is None
    assert resolve_feed(spark, spec, FeedNames(lsn="ID")).count() == 5
    assert not table_exists(spark, TableSpec("table", "no_such_table"))


def test_staging_and_text_export(spark, folder):
    df = spark.createDataFrame(
        [(2, "a\tb", None, datetime.datetime(2024, 1, 2)), (1, 'q"x', True, None)],
        "id int, s string, b boolean, t timestamp_ntz",
    )
    assert rows(stage(df, folder("stage"))) == rows(df)
    path = folder("tsv")
    write_tsv(df, path)
    lines = sorted(r[0] for r in spark.read.text(path).collect())
    assert lines == ['1\tq"x\t1\t', "2\ta b\t\t2024-01-02 00:00:00.000"]
    assert [r["id"] for r in cluster_by_key(df, "id").collect()] == [1, 2]

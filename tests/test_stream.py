import pytest

from conftest import rows
from tablesync.model import FeedNames
from tablesync.plans.jobs import Endpoints, GuardFailed, Options, SyncEngine
from tablesync.sinks.control_store import ControlStore
from tablesync.sinks.snapshot import SnapshotTarget
from tablesync.streaming import stream as sm
from test_jobs import mapping

NAMES = FeedNames("lsn", "seqval", "op")
FEED = "lsn string, seqval string, op int, id int, v string"


class Flow:
    """A file stream of changes into a target, run batch by batch (one file each)."""

    def __init__(self, spark, folder, mode):
        self.spark, self.mode = spark, mode
        self.feed, self.checkpoint = folder("feed"), folder("checkpoint")
        self.target = SnapshotTarget(spark, folder("target"), "id", 2)
        self.store = ControlStore(spark, folder("control"))
        self.source = {1: "a", 2: "b"}
        self.target.overwrite(self.source_table())

    def source_table(self):
        return self.spark.createDataFrame(list(self.source.items()), "id int, v string")

    def emit(self, *entries):
        values = [(f"{a:020x}", f"{b:020x}", op, i, v) for a, b, op, i, v in entries]
        self.spark.createDataFrame(values, FEED).coalesce(1).write.mode("append").parquet(self.feed)

    def run(self):
        stream = self.spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(self.feed)
        query = sm.stream_sync(
            stream, self.source_table, self.target, self.checkpoint, self.mode, None, NAMES, self.store, 1, 7
        )
        query.awaitTermination()

    def content(self):
        return dict(rows(self.target.read()))


def test_replace_mode_follows_the_source(spark, folder):
    flow = Flow(spark, folder, "replace")
    flow.source = {1: "aa", 3: "c"}
    flow.emit((1, 1, 4, 1, "old text of the change"), (1, 2, 1, 2, "b"))
    flow.emit((2, 1, 2, 3, "c"), (2, 2, 4, 3, "c"))
    flow.run()
    assert flow.content() == {1: "aa", 3: "c"}
    flow.source[4] = "d"
    flow.emit((3, 1, 2, 4, "d"))
    flow.run()
    assert flow.content() == {1: "aa", 3: "c", 4: "d"}
    assert flow.target.properties()["batch"] == 2
    found = flow.store.logs().collect()
    assert sorted(r["records_count"] for r in found) == [1, 1, 1] and flow.store.state(1)["last_cdc_sync_at"]


def test_ops_mode_drops_late_changes_even_of_deleted_keys(spark, folder):
    flow = Flow(spark, folder, "ops")
    flow.emit((5, 1, 4, 1, "new"), (5, 2, 1, 2, "b"), (5, 3, 2, 3, "c"))
    flow.run()
    assert flow.content() == {1: "new", 3: "c"}
    flow.emit((4, 1, 4, 1, "late"), (4, 2, 4, 2, "late"), (6, 1, 4, 3, "cc"))
    flow.emit((6, 2, 2, 2, "again"))
    flow.run()
    assert flow.content() == {1: "new", 2: "again", 3: "cc"}


@pytest.mark.parametrize("mode", ["replace", "ops"])
@pytest.mark.parametrize("broken", ["before the apply", "after the target"])
def test_a_batch_that_failed_is_repeated(spark, folder, mode, broken, monkeypatch):
    flow = Flow(spark, folder, mode)
    flow.source = {1: "x", 2: "b"}
    flow.emit((1, 1, 4, 1, "x"))

    def fail(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if broken == "before the apply":
            m.setattr(flow.target, "publish", fail)
        else:
            m.setattr(flow.store, "append_logs", fail)
        with pytest.raises(Exception, match="lost"):
            flow.run()
    assert flow.content() == ({1: "a", 2: "b"} if broken == "before the apply" else {1: "x", 2: "b"})
    flow.run()
    assert flow.content() == {1: "x", 2: "b"}
    assert flow.target.properties()["batch"] == 0
    flow.source[2] = "y"
    flow.emit((2, 1, 4, 2, "y"))
    flow.run()
    assert flow.content() == {1: "x", 2: "y"}


def test_newer_changes(spark):
    latest = spark.createDataFrame([("2", "1", 4, 1, "a"), ("1", "9", 4, 2, "b"), ("1", "1", 4, 3, "c")], FEED)
    positions = spark.createDataFrame([(1, "1", "9"), (2, "1", "9")], "id int, __lsn string, __seqval string")
    assert sorted(r["id"] for r in sm.newer_changes(latest, positions, "id", NAMES).collect()) == [1, 3]


def test_positions_are_filtered_where_they_lie(spark, folder):
    """A small batch broadcasts its keys: the positions of all keys ever changed are on no side of a shuffle."""
    positions = SnapshotTarget(spark, folder("known"), "id", 4)
    positions.overwrite(spark.range(1000).selectExpr("cast(id as int) id", "'1' __lsn", "'1' __seqval"))
    latest = spark.createDataFrame([("2", "1", 4, 1, "a"), ("1", "1", 4, 2, "b"), ("1", "1", 4, 2000, "c")], FEED)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        newer = sm.newer_changes(latest, sm.known_positions(positions, latest), "id", NAMES)
        assert "Exchange hashpartitioning" not in newer._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["id"] for r in newer.collect()) == [1, 2000]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_polling_runs_until_it_is_stopped(spark, folder):
    flow = Flow(spark, folder, "replace")
    flow.source[3] = "c"
    flow.emit((1, 1, 2, 3, "c"))
    stream = spark.readStream.schema(FEED).parquet(flow.feed)
    query = sm.stream_sync(stream, flow.source_table, flow.target, flow.checkpoint, trigger="1 second", names=NAMES)
    try:
        query.processAllAvailable()
        assert flow.content() == {1: "a", 2: "b", 3: "c"}
    finally:
        query.stop()


def test_unknown_mode(spark, folder):
    flow = Flow(spark, folder, "merge")
    flow.emit((1, 1, 4, 1, "x"))
    with pytest.raises(ValueError, match="mode"):
        flow.run()


def test_a_new_checkpoint_at_the_same_place_is_another_stream(spark, folder):
    flow = Flow(spark, folder, "replace")
    flow.target.overwrite(flow.source_table(), {"stream": flow.checkpoint, "batch": 5})
    flow.source = {1: "new", 2: "b"}
    flow.emit((1, 1, 4, 1, "new"))
    flow.run()
    assert flow.content() == {1: "new", 2: "b"}


class Requested(Flow):
    """A stream with an engine over the same tables: full syncs may be requested between its batches."""

    def __init__(self, spark, folder, mode="replace", exists=True):
        super().__init__(spark, folder, mode)
        if not exists:
            self.target = SnapshotTarget(spark, folder("none-yet"), "id", 2)
        ends = Endpoints(self.source_table, self.batch_feed, self.target)
        self.engine = SyncEngine(spark, self.store, lambda m: ends, Options(feed_names=NAMES))
        self.mapping = mapping(is_full_sync=not exists)
        self.upto = None  # the last position that a full sync sees in the feed; None: all

    def batch_feed(self):
        feed = self.spark.read.schema(FEED).parquet(self.feed)
        return feed if self.upto is None else feed.where(feed["lsn"] <= f"{self.upto:020x}")

    def run(self):
        stream = self.spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(self.feed)
        sm.stream_sync(
            stream, self.source_table, self.target, self.checkpoint, self.mode, None, NAMES, engine=self.engine, mapping=self.mapping
        ).awaitTermination()

    def log(self):
        return [(r["log_type"], r["status"]) for r in self.store.logs().orderBy("log_id").collect()]


@pytest.mark.parametrize("mode", ["replace", "ops"])
def test_a_requested_full_sync_runs_before_the_batch_and_hands_over_its_position(spark, folder, mode):
    flow = Requested(spark, folder, mode, exists=False)
    flow.upto, flow.source = 2, {1: "now", 3: "c"}
    flow.emit((1, 1, 4, 1, "older than the copy"), (2, 1, 1, 2, "b"), (3, 1, 4, 3, "after the copy"))
    if mode == "replace":
        flow.source[3] = "after the copy"
    flow.run()
    assert flow.content() == {1: "now", 3: "after the copy"} and flow.store.position(1) == f"{2:020x}"
    assert flow.log() == [("FULL_SYNC", "INFO"), ("FULL_SYNC", "SUCCESS"), ("CDC", "SUCCESS")]
    flow.upto, flow.source = 4, {1: "all new"}
    flow.engine.request_full_sync(1)
    flow.emit((4, 1, 4, 1, "older again"))
    flow.run()
    assert flow.content() == {1: "all new"} and not flow.engine.full_sync_requested(flow.mapping)


def test_a_failed_full_sync_stops_the_stream_before_its_batch(spark, folder):
    flow = Requested(spark, folder, exists=False)
    flow.emit((1, 1, 4, 1, "x"))
    good, flow.source_table = flow.source_table, lambda: (_ for _ in ()).throw(OSError("no route"))
    flow.engine.locate = lambda m: Endpoints(flow.source_table, flow.batch_feed, flow.target)
    with pytest.raises(Exception, match="Full sync before batch 0 failed"):
        flow.run()
    assert not flow.target.exists() and flow.engine.full_sync_requested(flow.mapping)
    flow.source_table = good
    flow.run()
    assert flow.content() == {1: "a", 2: "b"}


def test_a_failure_after_the_full_sync_repeats_the_batch_only(spark, folder, monkeypatch):
    flow = Requested(spark, folder, exists=False)
    flow.upto = 0
    flow.emit((1, 1, 4, 1, "a"))
    plain = flow.target.stage_replace
    with monkeypatch.context() as m:
        m.setattr(flow.target, "stage_replace", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            flow.run()
    assert plain and flow.content() == {1: "a", 2: "b"} and not flow.engine.full_sync_requested(flow.mapping)
    flow.source[1] = "aa"
    flow.run()
    assert flow.content() == {1: "aa", 2: "b"}
    assert [s for t, s in flow.log() if t == "FULL_SYNC"] == ["INFO", "SUCCESS"]


@pytest.mark.parametrize("mode", ["replace", "ops"])
def test_rows_that_do_not_arrive_stop_the_stream(spark, folder, monkeypatch, mode):
    flow = Requested(spark, folder, mode)
    flow.source[1] = "x"
    flow.emit((1, 1, 4, 1, "x"))
    with monkeypatch.context() as m:
        m.setattr(flow.target, "staged_rows", lambda staged: 0)
        with pytest.raises(Exception, match="none imported"):
            flow.run()
    assert flow.content() == {1: "a", 2: "b"}
    flow.run()
    assert flow.content() == {1: "x", 2: "b"}


def test_changes_without_a_key_are_a_warning(spark, folder):
    flow = Requested(spark, folder)
    flow.emit((1, 1, 4, None, "x"))
    before = flow.target.manifest()[0]
    flow.run()
    assert flow.log() == [("CDC", "WARNING")] and flow.target.manifest()[0] == before
    flow.source[1] = "y"
    flow.emit((2, 1, 4, 1, "y"))
    flow.run()
    assert flow.content() == {1: "y", 2: "b"} and flow.log()[1:] == [("CDC", "SUCCESS")]


def test_a_feed_without_the_key_is_refused(spark, folder):
    flow = Flow(spark, folder, "replace")
    flow.emit((1, 1, 4, 1, "x"))
    stream = spark.readStream.schema(FEED).parquet(flow.feed).drop("id")
    with pytest.raises(GuardFailed, match="id"):
        sm.stream_sync(stream, flow.source_table, flow.target, flow.checkpoint, names=NAMES)
    with pytest.raises(ValueError, match="mapping"):
        sm.stream_sync(spark.readStream.schema(FEED).parquet(flow.feed), flow.source_table, flow.target, flow.checkpoint, names=NAMES,
                       engine=SyncEngine(spark, flow.store, lambda m: None))


class Expiring(Flow):
    """A stream in ops mode whose feed has a low position."""

    low = None

    def run(self):
        stream = self.spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(self.feed)
        sm.stream_sync(
            stream, self.source_table, self.target, self.checkpoint, "ops", None, NAMES,
            horizon=lambda: self.low and f"{self.low:020x}", expire_every=2,
        ).awaitTermination()

    def positions(self):
        known = SnapshotTarget(self.spark, f"{self.target.root}/positions", "id", 2).read()
        return {r["id"]: int(r["__lsn"], 16) for r in known.collect()}


def test_positions_before_the_horizon_are_forgotten(spark, folder):
    flow = Expiring(spark, folder, "ops")
    flow.emit((5, 1, 4, 1, "five"), (5, 2, 1, 2, "b"), (9, 1, 2, 3, "c"))
    flow.run()
    assert flow.positions() == {1: 5, 2: 5, 3: 9} and flow.content() == {1: "five", 3: "c"}
    flow.low = 7
    # Late ones inside the horizon are dropped by position, those before it in any case, also of keys never seen.
    flow.emit((8, 1, 4, 3, "late"), (6, 1, 2, 2, "before"), (4, 1, 2, 7, "before"), (7, 1, 4, 4, "at the horizon"), (12, 1, 4, 5, "new"))
    flow.run()
    assert flow.content() == {1: "five", 3: "c", 4: "at the horizon", 5: "new"}
    assert flow.positions() == {3: 9, 4: 7, 5: 12}  # batch 1 is the second one
    flow.low = 11
    flow.emit((11, 1, 1, 1, "five"))
    flow.emit((13, 1, 2, 2, "again"))
    flow.run()
    assert flow.content() == {2: "again", 3: "c", 4: "at the horizon", 5: "new"}
    assert flow.positions() == {1: 11, 2: 13, 5: 12}


def test_expiry_that_failed_is_made_up_for(spark, folder, monkeypatch):
    flow = Expiring(spark, folder, "ops")
    flow.emit((5, 1, 4, 1, "five"))
    flow.emit((9, 1, 4, 2, "nine"))
    flow.low = 5
    with monkeypatch.context() as m:
        m.setattr(sm, "expire_positions", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            flow.run()
    flow.low = 6
    flow.run()  # the second batch again
    assert flow.content() == {1: "five", 2: "nine"} and flow.positions() == {2: 9}

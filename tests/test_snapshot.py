import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablesync.functions.columns import generated_names, mark_generated
from tablesync.model import FeedNames
from tablesync.sinks.files import stage_keys
from tablesync.sinks.snapshot import SnapshotTarget
from tablesync.sources.folders import AlreadyPublished, Folder

NAMES = FeedNames("lsn", "seqval", "op")


def frame(spark, content):
    return spark.createDataFrame(list(content.items()), "id int, v string")


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id int")


@pytest.fixture
def start(spark):
    return frame(spark, {i: f"v{i}" for i in range(20)})


def target_at(spark, folder, **options):
    return SnapshotTarget(spark, folder("target"), "id", **{"buckets": 4, **options})


# The three ways a pass can take: pending rows, fold with broadcast keys, fold with a shuffle join.
def pending(target):
    return target


def fold_broadcast(target):
    target.pending_rows = -1
    return target


def fold_shuffle(target):
    target.broadcast_bytes = 0
    return target


@pytest.mark.parametrize("way", [pending, fold_broadcast, fold_shuffle])
@pytest.mark.parametrize("buckets", [4, 5])
def test_replace_takes_every_way_with_the_same_result(spark, folder, start, way, buckets):
    target = way(target_at(spark, folder, buckets=buckets))
    target.overwrite(start)
    source = frame(spark, {0: "new", 1: "new", 99: "new"})
    staged = target.replace_by_keys(source, keys(spark, 0, 2, 99, 77))
    want = {i: f"v{i}" for i in range(20)} | {0: "new", 99: "new"}
    want.pop(2)
    assert rows(target.read()) == rows(frame(spark, want))
    assert (staged.keys, staged.deleted, staged.fresh) == (4, 2, 2)
    assert target.staged_rows(staged) == staged.kept + staged.fresh
    assert bool(target.manifest()[1]["pending"]) == (way is pending)
    again = target.replace_by_keys(source, keys(spark, 0, 2, 99, 77))
    assert rows(target.read()) == rows(frame(spark, want))
    assert again.deleted == 2


def test_many_passes_mix_pending_and_folds(spark, folder, start):
    target = target_at(spark, folder, pending_rows=3, compact_every=2)
    target.overwrite(start)
    want = {i: f"v{i}" for i in range(20)}
    ways = []
    for n in range(6):
        change = {(5 * n + k) % 25: f"p{n}" for k in range(3)}
        gone = (5 * n + 3) % 25
        target.replace_by_keys(frame(spark, change), keys(spark, *change, gone))
        want = {**want, **change}
        want.pop(gone, None)
        assert rows(target.read()) == rows(frame(spark, want))
        ways.append(bool(target.manifest()[1]["pending"]))
    assert True in ways and False in ways
    target.fold()
    assert target.manifest()[1]["pending"] is None
    assert rows(target.read()) == rows(frame(spark, want))


def test_emptied_buckets_stay_empty(spark, folder, start):
    for way in (pending, fold_broadcast, fold_shuffle):
        target = way(target_at(spark, folder))
        target.overwrite(start)
        staged = target.delete_by_keys(start.select("id"))
        assert target.read().count() == 0 and staged.deleted == 20
        target.replace_by_keys(start, keys(spark, 1))
        assert rows(target.read()) == [(1, "v1")]


def test_untouched_buckets_are_not_rewritten(spark, folder, start):
    target = fold_broadcast(target_at(spark, folder, buckets=8))
    target.overwrite(start)
    before = target.manifest()[1]["data"]
    target.replace_by_keys(start, keys(spark, 1))
    after = target.manifest()[1]["data"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_nothing_is_visible_before_publishing(spark, folder, start):
    target = target_at(spark, folder)
    assert not target.exists()
    staged = target.stage_overwrite(start)
    assert not target.exists()
    with pytest.raises(ValueError, match="no published version"):
        target.read()
    target.publish(staged)
    assert target.read().count() == 20
    target.stage_replace(frame(spark, {}), keys(spark, 1))
    assert target.read().count() == 20


def test_failed_write_leaves_the_table(spark, folder, start):
    target = target_at(spark, folder)
    target.overwrite(start)
    broken = start.withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise("x"))
    with pytest.raises(Exception, match="boom"):
        target.overwrite(broken)
    with pytest.raises(Exception, match="boom"):
        target.replace_by_keys(broken, keys(spark, 3))
    assert rows(target.read()) == rows(start)


def test_second_writer_fails(spark, folder, start):
    target = target_at(spark, folder)
    target.overwrite(start)
    other = SnapshotTarget(spark, target.root, "id", 4)
    mine, theirs = target.stage_replace(start, keys(spark, 1)), other.stage_replace(start, keys(spark, 2))
    target.publish(mine)
    with pytest.raises(AlreadyPublished):
        other.publish(theirs)


def test_versions_append_and_vacuum(spark, folder, start):
    target = target_at(spark, folder)
    target.overwrite(start.where("id < 10"))
    target.replace_by_keys(frame(spark, {}), keys(spark, 1))
    target.append(start.where("id >= 10 or id = 1"))
    assert rows(target.read()) == rows(start)
    assert target.read(version=0).count() == 10
    target.overwrite(start.limit(3))
    dropped = target.vacuum(keep=1)
    assert dropped and target.read().count() == 3
    assert target.vacuum(keep=1) == []


def test_old_versions_are_removed_on_the_way(spark, folder, start):
    target = target_at(spark, folder, keep_versions=3)
    target.overwrite(start)
    for n in range(6):
        target.replace_by_keys(frame(spark, {1: f"n{n}"}), keys(spark, 1))
    assert len(target._versions.numbers()) <= 4
    assert len(Folder(spark, f"{target.root}/pending").names()) <= 4
    assert rows(target.read().where("id = 1")) == [(1, "n5")] and target.read().count() == 20


def test_versions_stay_without_being_told(spark, folder, start):
    target = target_at(spark, folder)
    target.overwrite(start)
    before = target.read()
    for n in range(5):
        target.delete_by_keys(keys(spark, n))
    assert target.keep_versions is None and len(target._versions.numbers()) == 6
    assert before.count() == 20 and target.read().count() == 15


def test_deleted_rows_are_counted_in_touched_buckets(spark, folder, start, monkeypatch):
    target = target_at(spark, folder)
    target.overwrite(start)
    target.replace_by_keys(frame(spark, {2: "x"}), keys(spark, 2))
    scanned, base = [], SnapshotTarget._base

    def seen(self, document, buckets):
        scanned.append(list(buckets))
        return base(self, document, buckets)

    monkeypatch.setattr(SnapshotTarget, "_base", seen)
    assert target.stage_replace(start, keys(spark, 1, 99)).deleted == 1
    assert target.stage_replace(start, keys(spark, 2)).deleted == 1
    assert scanned and all(len(b) <= 2 for b in scanned) and len(scanned[-1]) == 1


def test_null_keys_survive_every_pass(spark, folder):
    start = spark.createDataFrame([(None, "n"), (1, "a")], "id int, v string")
    for way in (pending, fold_broadcast, fold_shuffle):
        target = way(target_at(spark, folder))
        target.overwrite(start)
        target.replace_by_keys(frame(spark, {1: "b"}), spark.createDataFrame([(1,), (None,)], "id int"))
        assert rows(target.read()) == [(1, "b"), (None, "n")]
        assert target.replace_by_keys(start, spark.createDataFrame([(None,)], "id int")).keys == 0


def test_keys_and_source_of_other_types(spark, folder, start):
    for way in (pending, fold_broadcast, fold_shuffle):
        target = way(target_at(spark, folder))
        target.overwrite(start)
        source = start.select(F.col("id").cast("bigint").alias("ID"), F.lit("new").alias("V"), F.lit(1).alias("extra"))
        target.replace_by_keys(source, spark.createDataFrame([("3",)], "Id string"))
        assert rows(target.read().where("id = 3")) == [(3, "new")]
        assert target.read().schema.simpleString() == "struct<id:int,v:string>"


@pytest.mark.parametrize("feed_type,source_type", [("string", "string"), ("string", "int"), ("int", "string"), ("int", "int")])
def test_key_ranges_follow_the_order_of_their_type(spark, folder, start, feed_type, source_type):
    """As text '10' sorts before '9'; a range measured in one type must not be used in another."""
    target = target_at(spark, folder)
    target.overwrite(start)
    changes = spark.createDataFrame([(9,), (10,), (5,)], "id int").select(F.col("id").cast(feed_type))
    source = start.select(F.col("id").cast(source_type), F.lit("new").alias("v")).where("id <> 5")
    key_set, stats = stage_keys(changes, "id", folder("keys"))
    staged = target.replace_by_keys(source, key_set, stats=stats)
    assert (staged.deleted, staged.fresh) == (3, 2)
    assert rows(target.read().where("v = 'new'")) == [(10, "new"), (9, "new")]


def test_keys_changed_again_are_counted_once(spark, folder, start):
    target = target_at(spark, folder)
    target.overwrite(start)
    for _ in range(3):
        target.replace_by_keys(start, keys(spark, 1, 2))
    assert target.manifest()[1]["pending"]["keys"] == 2


def test_composite_string_key(spark, folder):
    df = spark.createDataFrame([("a'b", 1, "x"), ("a/b", 2, "y")], "k string, n int, v string")
    target = SnapshotTarget(spark, folder(), ["k", "n"], 4)
    target.overwrite(df)
    target.delete_by_keys(spark.createDataFrame([("a'b", 1), ("a/b", 1)], "k string, n int"))
    assert rows(target.read()) == [("a/b", 2, "y")]


def test_apply_ops_ways(spark, folder, start):
    latest = spark.createDataFrame(
        [("1", "1", 1, 0, None), ("1", "2", 4, 1, "up"), ("1", "3", 2, 50, "in")],
        "lsn string, seqval string, op int, id int, v string",
    )
    for way in (pending, fold_broadcast, fold_shuffle):
        target = way(target_at(spark, folder))
        target.overwrite(start)
        staged = target.apply_ops(latest, NAMES)
        found = {r["id"]: r["v"] for r in target.read().collect()}
        assert 0 not in found and found[1] == "up" and found[50] == "in" and len(found) == 20
        assert (staged.keys, staged.deleted, staged.fresh) == (3, 2, 2)


def test_generated_columns_are_remembered(spark, folder, start):
    target = target_at(spark, folder)
    target.overwrite(mark_generated(start, "v", "rowversion"))
    assert generated_names(target.read()) == {"v"}
    target.replace_by_keys(start, keys(spark, 1))
    assert generated_names(target.read()) == {"v"}


def test_hot_key_is_split_over_tasks(spark, folder):
    """A key with most of the rows must not end in one file written by one task."""
    hot = spark.range(0, 300_000, 1, 4).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).cast("int").alias("id"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
    )
    target = target_at(spark, folder)
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    try:
        for name in names:
            spark.conf.set(name, "1m")
        target.overwrite(hot)
    finally:
        for name in names:
            spark.conf.unset(name)
    data = target.manifest()[1]["data"]
    counts = [
        sum(n.endswith(".parquet") for n in Folder(spark, f"{target.root}/data/{f}/tablesync_bucket={b}").names())
        for b, folders in data.items() for f in folders
    ]
    assert max(counts) > 3
    assert target.read().count() == 300_000


def test_counts_without_the_scan(spark, folder, start):
    target = target_at(spark, folder, count_deleted=False)
    target.overwrite(start)
    assert target.replace_by_keys(start, keys(spark, 1)).deleted is None


def test_read_columns_are_pruned(spark, folder, start):
    target = target_at(spark, folder)
    target.overwrite(start)
    text = target.read().select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int>" in text

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablesync.model import ERROR, SUCCESS
from tablesync.operators.ledger import LedgerRules
from tablesync.plans.chunks import Chunks
from tablesync.plans import jobs
from test_jobs import World, lsn, mapping


@pytest.fixture
def world(spark, folder):
    made = World(spark, folder, chunks=4)
    made.now = {i: f"v{i}" for i in range(1, 41)}
    return made


def in_step(world):
    return sorted(rows(world.target.read())) == sorted(world.now.items())


def dealt(df, key, n):
    chunks = Chunks.cut(df, key, n)
    parts = [rows(df.where(chunks.part(df, key, i))) for i in range(chunks.n)]
    assert sorted((r for p in parts for r in p), key=repr) == rows(df)
    return chunks, parts


def test_ranges_hold_every_row_once(spark):
    df = spark.createDataFrame([(i, "x") for i in range(100)] + [(None, "n"), (None, "m"), (5, "again")], "id int, v string")
    chunks, parts = dealt(df, "id", 4)
    assert chunks.n == 4 and all(20 <= len(p) <= 30 for p in parts) and (None, "n") in parts[0]
    plan = df.where(chunks.part(df, "id", 2))._jdf.queryExecution().toString()
    assert "xxhash64" not in plan


@pytest.mark.parametrize("kind", ["decimal(12,2)", "double", "date", "timestamp", "timestamp_ntz", "bigint"])
def test_ranges_of_other_types(spark, kind):
    day = F.expr("date_add(DATE'2024-01-01', CAST(id AS INT))")
    df = spark.range(50).select((day if kind in ("date", "timestamp", "timestamp_ntz") else F.col("id") / 3).cast(kind).alias("k"))
    assert dealt(df, "k", 3)[0].n == 3


def test_texts_and_composite_keys(spark):
    df = spark.createDataFrame([(f"k{i}", i % 3) for i in range(60)] + [(None, 1)], "k string, n int")
    chunks, parts = dealt(df, "k", 4)
    assert chunks.bounds is None and all(parts)
    assert dealt(df, ["n", "k"], 3)[0].bounds is not None


def test_few_keys_and_empty_tables(spark):
    one = spark.createDataFrame([(7, "a")] * 9, "id int, v string")
    assert max(len(p) for p in dealt(one, "id", 5)[1]) == 9
    dealt(one.limit(0), "id", 5)
    dealt(one, "id", 1)


def test_a_copy_in_chunks(world):
    world.change(1, 100, "c")
    assert [r.status for r in world.engine.sync_mapping(world.mapping)] == [SUCCESS, SUCCESS]
    assert in_step(world) and world.position() == lsn(1)
    assert world.store.state(1)["snapshot"] == {} and not world.engine.full_sync_requested(world.mapping)
    world.now = {1: "only"}
    world.engine.request_full_sync(1)
    world.engine.full_sync(world.mapping)
    assert in_step(world)


def test_rows_that_change_while_a_chunk_is_copied_are_left_out_until_the_change_sync(world, monkeypatch):
    plain, calls = jobs.copy_chunk, []

    def during(target, df, key, chunks, number, watermark, feed, names):
        def moving():
            calls.append(1)
            if len(calls) == 4:  # the high watermark of the second chunk
                for at, (k, v) in enumerate([(2, "early"), (15, "inside"), (16, None), (39, "later"), (500, "new")], 10):
                    world.change(at, k, v)
            return watermark()

        return plain(target, df, key, chunks, number, moving, feed, names)

    monkeypatch.setattr(jobs, "copy_chunk", during)
    assert world.engine.full_sync(world.mapping).status == SUCCESS
    copy = dict(rows(world.target.read()))
    # Chunk 1 is as it was, rows of chunk 2 that changed are missing, chunks 3 and 4 are as they are now.
    assert copy[2] == "v2" and 15 not in copy and 16 not in copy and copy[39] == "later" and copy[500] == "new" and len(copy) == 39
    assert world.position() == lsn(0)
    assert world.engine.cdc_sync(world.mapping).status == SUCCESS
    assert in_step(world)


def test_a_failed_copy_goes_on_with_its_chunk(world):
    world.change(1, 3, "c")
    reads, good = [], world.source

    def failing():
        reads.append(1)
        if len(reads) == 3:
            raise OSError("lost")
        return good()

    world.source = failing
    world.engine.locate = lambda m: jobs.Endpoints(world.source, world.feed, world.target)
    assert world.engine.full_sync(world.mapping).status == ERROR
    assert len(world.store.state(1)["snapshot"]["parts"]) == 2 and not world.target.exists()
    world.change(2, 1, "changed after its chunk was copied")
    world.change(3, 2, None)
    before = len(reads)
    results = world.engine.sync_mapping(world.mapping)
    assert [r.status for r in results] == [SUCCESS, SUCCESS] and len(reads) - before == 3  # two chunks, then the change sync
    assert results[1].changes == 2 and in_step(world) and world.position() == lsn(3)
    assert any("chunk 3 of 4" in r["log_message"] for r in world.store.logs().collect())


@pytest.mark.parametrize("what", ["feed purged", "schema", "request", "vacuum", "no feed"])
def test_a_copy_that_cannot_go_on_begins_anew(world, spark, what):
    world.change(5, 3, "c")
    reads, good = [], world.source

    def failing():
        reads.append(1)
        if len(reads) == 3:
            raise OSError("lost")
        return good()

    world.engine.locate = lambda m: jobs.Endpoints(world.source, world.feed, world.target)
    world.source = failing
    assert world.engine.full_sync(world.mapping).status == ERROR
    world.source, m = good, world.mapping
    if what == "feed purged":
        world.entries = []
        world.change(9, 1, "x")
    elif what == "schema":
        world.source = lambda: good().withColumn("more", F.lit(1))
    elif what == "request":
        world.engine.request_full_sync(1)
    elif what == "vacuum":
        from tablesync.sources.folders import Folder

        Folder(spark, f"{world.target.root}/data").delete()
    else:
        m = mapping(cdc_enabled=False)
    assert world.engine.full_sync(m).status == SUCCESS
    assert not any("goes on" in r["log_message"] for r in world.store.logs().collect())
    assert sorted(rows(world.target.read().select("id", "v"))) == sorted(world.now.items())


def test_failure_before_the_state_publishes_again(world, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(world.target, "publish", lambda staged: (_ for _ in ()).throw(OSError("lost")))
        assert world.engine.full_sync(world.mapping).status == ERROR
    assert world.engine.full_sync(world.mapping).status == SUCCESS and in_step(world)


def test_chunks_keep_a_ledger(world, spark):
    world.target.ledger_rules = LedgerRules(buckets=8)
    assert world.engine.full_sync(world.mapping).status == SUCCESS
    assert sum(r["rows"] for r in world.target.ledger()[0].collect()) == 40
    assert world.engine.verify_whole(world.mapping).status == SUCCESS

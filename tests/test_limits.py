import time

import pytest
from pyspark.sql import functions as F

from tablesync.model import ERROR, SUCCESS
from tablesync.plans.jobs import Endpoints, Options, SyncEngine
from tablesync.sinks.control_store import ControlStore
from tablesync.sinks.snapshot import SnapshotTarget
from test_jobs import NAMES, mapping


def hanging(df):
    def wait(batches):
        for batch in batches:
            time.sleep(300)
            yield batch

    return df.coalesce(1).mapInPandas(wait, df.schema)  # one task: the others find free cores


def engine_of(spark, folder, sources, **options):
    ends = {i: Endpoints(s, lambda: None, SnapshotTarget(spark, folder(f"target{i}"), "id", 2)) for i, s in sources.items()}
    store = ControlStore(spark, folder("control"))
    return SyncEngine(spark, store, lambda m: ends[m.mapping_id], Options(feed_names=NAMES, **options)), ends


def table(spark, n=20):
    return spark.range(n).select(F.col("id").cast("int").alias("id"), F.lit("v").alias("v"))


def test_a_hanging_mapping_is_cancelled_alone(spark, folder):
    sources = {i: lambda: table(spark) for i in (1, 3, 4)}
    sources[2] = lambda: hanging(table(spark))
    warm, _ = engine_of(spark, folder, {9: lambda: table(spark)})
    warm.sync_all([mapping(9, cdc_enabled=False)])  # the first job of a session takes longer than others
    engine, ends = engine_of(spark, folder, sources, time_limit=30, parallelism=2)
    begun = time.monotonic()
    results = engine.sync_all([mapping(i, cdc_enabled=False) for i in sources])
    assert time.monotonic() - begun < 200
    found = {r.mapping_id: (r.status, r.message) for r in results}
    assert found[2] == (ERROR, "Cancelled after the limit of 30 seconds")
    assert all(found[i][0] == SUCCESS and ends[i].target.read().count() == 20 for i in (1, 3, 4)) and not ends[2].target.exists()
    logged = {r["mapping_id"]: r["status"] for r in engine.store.logs().where("duration_ms IS NOT NULL").collect()}
    assert logged == {1: SUCCESS, 2: ERROR, 3: SUCCESS, 4: SUCCESS}
    assert engine.full_sync_requested(mapping(2))  # asked for still
    assert not set(spark.sparkContext.getJobTags()) and spark.range(3).count() == 3


def test_what_starts_after_the_limit_is_cancelled_too(spark, folder):
    def late():
        time.sleep(3)  # the limit passes while the driver runs no Spark job
        return hanging(table(spark))

    engine, _ = engine_of(spark, folder, {1: late}, time_limit=1)
    begun = time.monotonic()
    assert [r.message for r in engine.sync_all([mapping(1, cdc_enabled=False)])] == ["Cancelled after the limit of 1 seconds"]
    assert time.monotonic() - begun < 60


@pytest.mark.parametrize("limit", [None, 300])
def test_every_mapping_has_a_pool(spark, folder, limit):
    seen = {}

    def source(i):
        def read():
            seen[i] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
            return table(spark)

        return read

    engine, _ = engine_of(spark, folder, {1: source(1), 2: source(2)}, time_limit=limit)
    assert {r.status for r in engine.sync_all([mapping(i, cdc_enabled=False) for i in (1, 2)])} == {SUCCESS}
    assert seen == {1: "mapping-1", 2: "mapping-2"} and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None

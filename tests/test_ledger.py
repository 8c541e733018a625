import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablesync.functions.columns import mark_generated
from tablesync.model import FAILED, SUCCESS
from tablesync.operators import ledger as lg
from tablesync.operators.ledger import LedgerRules
from tablesync.operators.verify import verify_buckets, verify_full
from tablesync.plans.jobs import Endpoints, SyncEngine
from tablesync.sinks.snapshot import SnapshotTarget
from test_jobs import World

RULES = LedgerRules(buckets=16)
SCHEMA = "id int, v string"


def target_at(spark, folder, **options):
    return SnapshotTarget(spark, folder("target"), "id", 4, ledger=RULES, **options)


def table(spark, values):
    return spark.createDataFrame(list(values.items()), SCHEMA)


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id int")


def scanned(target):
    """The ledger that a scan of the copy gives, as bucket checksums of a verification."""
    found = verify_buckets(target.read(), target.read(), "id", RULES.buckets)
    return {r["bucket"]: tuple(r[f"dst_{c}"] for c in ("rows", "sum0", "sum1", "sum2", "sum3")) for r in found.collect()}


def kept(target):
    return {r["bucket"]: tuple(r[c] for c in ("rows", "sum0", "sum1", "sum2", "sum3")) for r in target.ledger()[0].collect()}


@pytest.mark.parametrize("limits", [{}, {"pending_rows": -1}, {"broadcast_bytes": 0}])
def test_every_pass_keeps_the_ledger(spark, folder, limits):
    target, now = target_at(spark, folder, **limits), {i: f"v{i}" for i in range(60)}
    target.overwrite(table(spark, now))
    assert kept(target) == scanned(target)
    now.update({3: "x", 100: "new"})
    del now[7]
    target.replace_by_keys(table(spark, now), keys(spark, 3, 7, 100, 500))
    assert kept(target) == scanned(target) and sorted(rows(target.read())) == sorted(now.items())
    target.replace_by_keys(table(spark, now), keys(spark, 3, 8))
    target.delete_by_keys(keys(spark, 9))
    assert kept(target) == scanned(target)
    target.append(table(spark, {1000: "a", 1001: None}))
    assert kept(target) == scanned(target)
    target.fold()
    target.delete_by_keys(keys(spark, *range(2000)))
    assert kept(target) == {} and target.read().count() == 0


def test_a_failure_before_publishing_leaves_the_old_ledger(spark, folder):
    target, now = target_at(spark, folder), {i: "v" for i in range(20)}
    target.overwrite(table(spark, now))
    before = kept(target)
    changed = {**now, 1: "x"}
    target.stage_replace(table(spark, changed), keys(spark, 1))  # rows and ledger are written, the manifest is not
    assert kept(target) == before == scanned(target)
    target.replace_by_keys(table(spark, changed), keys(spark, 1))
    target.replace_by_keys(table(spark, changed), keys(spark, 1))  # repeated
    assert kept(target) == scanned(target) != before
    target.vacuum(1)
    assert kept(target) == scanned(target)


def test_a_table_without_ledger_or_with_other_rules_gets_one(spark, folder):
    target, now = target_at(spark, folder), {i: "v" for i in range(20)}
    target.ledger_rules = None
    target.overwrite(table(spark, now))
    assert target.ledger() is None
    for rules in (RULES, LedgerRules(buckets=3), RULES):
        target.ledger_rules = rules
        target.replace_by_keys(table(spark, {**now, 1: "x"}), keys(spark, 1))
        assert target.ledger()[1] == rules
    assert kept(target) == scanned(target)
    target.ledger_rules = None
    target.replace_by_keys(table(spark, now), keys(spark, 1))
    assert target.ledger() is None  # not kept up, so not kept


@pytest.mark.parametrize("rules", [RULES, LedgerRules(checksum="md5"), LedgerRules(bucket_of="id % 7")])
def test_verification_against_the_ledger(spark, folder, rules):
    target, now = SnapshotTarget(spark, folder("target"), "id", 4, ledger=rules), {i: f"v{i}" for i in range(50)}
    target.overwrite(table(spark, now))
    src = {**now, 4: "other", 77: None}
    del src[5]
    found = lg.verify_ledger(table(spark, src), target.read(), target.ledger()[0], "id", rules)
    assert rows(found) == [(4, "different"), (5, "missing_in_src"), (77, "missing_in_dst")] == rows(verify_full(table(spark, src), target.read(), "id"))
    assert rows(lg.verify_ledger(table(spark, now), target.read(), target.ledger()[0], "id", rules)) == []


def test_types_of_the_copy_decide(spark, folder):
    target = SnapshotTarget(spark, folder("target"), "id", 4, ledger=RULES)
    target.overwrite(spark.createDataFrame([(1, "5"), (2, "6")], "id bigint, v string"))
    src = spark.createDataFrame([(1, 5), (2, 7)], "ID int, V int")
    assert rows(lg.verify_ledger(src, target.read(), target.ledger()[0], "id", RULES)) == [(2, "different")]


def test_a_generated_column_of_the_source_is_not_covered(spark):
    copy = table(spark, {1: "a"})
    assert lg.same_columns(copy, copy, "id") and not lg.same_columns(mark_generated(copy, "v", "rowversion"), copy, "id")
    assert not lg.same_columns(copy.select("id"), copy, "id")


def test_whole_verification_uses_the_ledger(spark, folder, monkeypatch):
    world = World(spark, folder)
    world.target = SnapshotTarget(spark, folder("with-ledger"), "id", 2, ledger=RULES)
    world.engine = SyncEngine(spark, world.store, lambda m: Endpoints(world.source, world.feed, world.target), world.options)
    world.change(1, 3, "c")
    assert [r.status for r in world.engine.sync_mapping(world.mapping)] == [SUCCESS, SUCCESS]
    world.change(2, 1, "changed")
    world.change(3, 2, None)
    assert world.engine.cdc_sync(world.mapping).status == SUCCESS
    monkeypatch.setattr("tablesync.plans.jobs.verify_sets", None)  # would fail
    assert world.engine.verify_whole(world.mapping).status == SUCCESS
    world.now[3] = "unseen"
    found = world.engine.verify_whole(world.mapping)
    assert found.status == FAILED and found.mismatches == 1


def test_the_ledger_is_one_aggregation_of_the_source(spark, folder):
    target = target_at(spark, folder)
    target.overwrite(spark.range(2000).selectExpr("cast(id as int) as id", "cast(id as string) as v"))
    sums = lg.compare_ledger(lg.bucket_sums(target.read(), "id", RULES), target.ledger()[0])
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("HashAggregate") < plan.index("Exchange")
    assert sums.where(~F.col("equal")).count() == 0

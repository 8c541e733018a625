import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablesync.functions.columns import mark_generated
from tablesync.operators import reconcile as rc
from tablesync.operators import verify as vf


def both_ways(src, dst, key, **options):
    found = rows(rc.verify_sets(src, dst, key, **options))
    assert found == rows(vf.verify_full(src, dst, key))
    return found


def table(spark, n, changed=(), missing=()):
    df = spark.range(n).select("id", F.concat(F.lit("v"), F.col("id") % 97).alias("v"))
    df = df.where(~F.col("id").isin(list(missing))) if missing else df
    return df.withColumn("v", F.when(F.col("id").isin(list(changed)), F.concat("v", F.lit("!"))).otherwise(F.col("v"))) if changed else df


def test_hash_of_a_pair_is_that_of_spark(spark):
    pairs = [(random.Random(i).getrandbits(64) - (1 << 63), random.Random(-i).getrandbits(64) - (1 << 63)) for i in range(50)] + [(0, -1)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h"))
    assert all(rc.own_hash(r["a"], r["b"]) == r["h"] % (1 << 64) for r in df.collect())


def cells_of(items, size):
    """The cells of a sketch, built one item at a time."""
    cells = {}
    for key_hash, row_hash, n in items:
        own = rc.own_hash(key_hash, row_hash)
        for t in range(rc.TABLES):
            place = ((own >> (rc.CELL_BITS * t)) & ((1 << rc.CELL_BITS) - 1)) % size + t * size
            words = [w for h in (key_hash, row_hash, own) for w in rc._split(h)]
            have = cells.setdefault(place, [0] * (1 + len(words)))
            cells[place] = [have[0] + n, *[h + n * w for h, w in zip(have[1:], words, strict=True)]]
    return {c: s for c, s in cells.items() if any(s)}


@pytest.mark.parametrize("n", [0, 1, 2, 40, 300])
def test_peeling_gives_back_the_items(n):
    rng = random.Random(n)
    items = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63), rng.choice([1, -1, 2, -3])) for _ in range(n)]
    found, whole = rc.peel_cells(cells_of(items, 256), 256)
    assert whole and sorted(found) == sorted(items)


def test_peeling_tells_when_it_is_stuck():
    rng = random.Random(7)
    items = [(rng.getrandbits(63), rng.getrandbits(63), 1) for _ in range(2000)]
    found, whole = rc.peel_cells(cells_of(items, 256), 256)
    assert not whole and set(found) <= set(items)


def test_equal_tables(spark):
    assert both_ways(table(spark, 500), table(spark, 500), "id") == []
    empty = table(spark, 5).limit(0)
    assert both_ways(empty, empty, "id") == []


def test_few_differences_need_one_sketch(spark, monkeypatch):
    monkeypatch.setattr(rc, "_part", None)  # a second sketch would fail
    found = both_ways(table(spark, 5000, missing=[17]), table(spark, 5000, changed=[3, 4000], missing=[9]), "id")
    assert dict(found) == {3: "different", 4000: "different", 9: "missing_in_dst", 17: "missing_in_src"}


def test_more_differences_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(rc, "verify_full", None)  # nor are buckets compared
    changed = list(range(0, 6000, 7))
    assert len(rows(rc.verify_sets(table(spark, 6000), table(spark, 6000, changed=changed), "id"))) == len(changed)


def test_parts_that_do_not_peel_are_compared_item_by_item(spark, monkeypatch):
    calls, plain = [], rc._differing_in_parts
    monkeypatch.setattr(rc, "_differing_in_parts", lambda *a: calls.append(a[2]) or plain(*a))
    changed = list(range(0, 9000, 3))
    found = both_ways(table(spark, 9000), table(spark, 9000, changed=changed), "id", part_items=3000)
    assert calls and [k for k, _ in sorted(found)] == changed


def test_too_many_differences_are_left_to_buckets(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(rc, "verify_full", lambda *a, **k: calls.append(1) or vf.verify_full(*a, **k))
    both_ways(table(spark, 3000), table(spark, 3000, changed=list(range(0, 3000, 2))), "id", max_differences=100)
    assert calls


def test_repeated_keys_and_rows_are_multisets(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "x"), (3, "y"), (None, "n"), (4, "p"), (4, "p"), (4, "p")], "id int, v string")
    b = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "x"), (3, "x"), (None, "m"), (5, None)], "id int, v string")
    assert {k: s for k, s in both_ways(a, b, "id")} == {2: "different", 3: "different", None: "different", 4: "missing_in_dst", 5: "missing_in_src"}


def test_a_key_with_a_third_of_all_rows(spark):
    base = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"), (F.col("id") % 50).alias("v"))
    more = base.unionByName(spark.createDataFrame([(7, 99)], "id bigint, v bigint"))
    assert both_ways(base, base, "id") == [] and both_ways(more, base, "id") == [(7, "different")]


def test_types_case_generated_and_nested_columns(spark):
    src = spark.createDataFrame([(1, 5, [1, 2]), (2, 6, None), (3, 7, [])], "id int, v int, l array<int>")
    dst = spark.createDataFrame([("1", "5", [1, 2]), ("2", "6.0", None), ("4", None, [])], "ID string, V string, l array<int>")
    assert {k for k, _ in both_ways(src, dst, "id")} == {"2", "3", "4"}
    marked = mark_generated(src.withColumn("rv", F.rand()), "rv", "rowversion")
    assert both_ways(src, marked, "id") == []
    scaled = src.select("id", (F.col("v") + F.lit(1e-9)).alias("v"))
    assert rows(rc.verify_sets(src.select("id", F.col("v").cast("double")), scaled, "id", float_scale=2)) == []


def test_no_row_is_shuffled(spark, folder):
    base = folder("sides")
    table(spark, 4000).write.parquet(f"{base}/a")
    table(spark, 4000, changed=[5]).write.parquet(f"{base}/b")
    src, dst = (spark.read.parquet(f"{base}/{n}") for n in "ab")
    items, _, _ = rc._items(src, dst, "id", None)
    plan = rc.sketch(items, rc._stratum(), rc.STRATUM_CELLS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Exchange") < plan.rindex("HashAggregate")
    final = rc.verify_sets(src, dst, "id")._jdf.queryExecution().executedPlan().toString()
    # Hashes of the keys found are broadcast, rows of these keys are added up before they move.
    assert "SortMergeJoin" not in final and final.count("BroadcastHashJoin") == 2
    assert final.count("Exchange hashpartitioning(id") == 1

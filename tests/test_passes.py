import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablesync.model import SUCCESS, FeedNames
from tablesync.operators.changes import bounded_changes
from test_jobs import FEED, NAMES, World, lsn


def feed(spark, counts):
    entries = [(lsn(p), lsn(i), 4, i, "v") for p, n in counts.items() for i in range(n)]
    return spark.createDataFrame(entries, FEED)


def cut(counts, start, n):
    """The same cut one position at a time."""
    total, last = 0, None
    for p in sorted(counts):
        if p > start:
            if last is not None and total + counts[p] > n:
                return lsn(last)
            total, last = total + counts[p], p
            if total > n:
                return lsn(p)
    return None if last is None else lsn(last)


@pytest.mark.parametrize("seed", range(6))
def test_the_cut_is_that_of_a_walk_over_positions(spark, seed):
    rng = random.Random(seed)
    counts = {rng.choice([rng.randint(1, 40), rng.randint(1, 5000), rng.randint(1, 1 << 40)]): rng.choice([1, 1, 3, 30]) for _ in range(25)}
    df = feed(spark, counts).cache()
    for n in (1, 7, 40, 10_000):
        start = rng.choice([0, *counts])
        assert bounded_changes(df, lsn(start), n, NAMES, digits=rng.choice([1, 2, 3, 5])) == cut(counts, start, n)


def test_one_position_with_more_changes_than_allowed(spark):
    df = feed(spark, {1: 2, 2: 50, 3: 1})
    assert bounded_changes(df, None, 10, NAMES) == lsn(1)
    assert bounded_changes(df, lsn(1), 10, NAMES) == lsn(2) and bounded_changes(df, lsn(2), 10, NAMES) == lsn(3)
    assert bounded_changes(df, lsn(3), 10, NAMES) is None and bounded_changes(df.limit(0), None, 1, NAMES) is None
    with pytest.raises(ValueError):
        bounded_changes(df, None, 0, NAMES)


def test_binary_positions_and_other_spellings(spark):
    df = feed(spark, {1: 2, 300: 2, 301: 2})
    binary = df.withColumns({c: F.unhex(c) for c in ("lsn", "seqval")})
    assert bounded_changes(binary, lsn(1), 2, NAMES) == lsn(300)
    words = df.withColumn("lsn", F.concat(F.lit("P"), F.regexp_replace("lsn", "^0+", "")))  # of different lengths
    assert [bounded_changes(words, None, n, NAMES) for n in (1, 4, 6)] == ["P1", "P12c", "P12d"]


def test_every_pass_is_bounded_and_nothing_is_lost(spark, folder):
    world = World(spark, folder, max_changes=5)
    world.engine.full_sync(world.mapping)
    for i in range(40):
        world.change(1 + i // 3 if i < 20 else 30, i % 11, None if i % 5 == 4 else f"v{i}")
    sizes = []
    while (result := world.engine.cdc_sync(world.mapping)).changes:
        assert result.status == SUCCESS
        sizes.append(result.changes)
    assert sum(sizes) == 40 and max(s for s in sizes if s != 20) <= 5 and sizes[-1] == 20  # one position has 20
    assert sorted(rows(world.target.read())) == sorted(world.now.items())


def test_both_bounds_hold(spark, folder):
    world = World(spark, folder, max_changes=100, max_positions=1)
    world.engine.full_sync(world.mapping)
    for i in range(4):
        world.change(i + 1, i, "x")
    assert [world.engine.cdc_sync(world.mapping).changes for _ in range(5)] == [1, 1, 1, 1, 0]


def test_a_step_filters_the_scan_and_sorts_no_positions(spark, folder):
    path = folder("feed")
    feed(spark, {i: 2 for i in range(1, 3000)}).write.parquet(path)
    stored, plans = spark.read.parquet(path), []
    plain = type(stored).agg

    def seen(df, *columns):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, *columns)

    type(stored).agg = seen
    try:
        assert bounded_changes(stored, None, 1001, FeedNames("lsn", "seqval", "op")) == lsn(500)
    finally:
        type(stored).agg = plain
    assert any("StartsWith" in p for p in plans) and not any("Sort" in p for p in plans)
    assert all("seqval" not in p.split("Relation")[0] for p in plans)

"""Shares against the given weights, with thousands of sources."""

import pytest

from tablesync.llm import mixing


def furthest(spark, weights):
    """Largest distance in blocks from the given weights, over a period, and the period."""
    parts = mixing.shares(spark.createDataFrame(list(weights.items()), "key string, weight long"))
    total, worst, slots, period = sum(weights.values()), 0, [], 0
    for r in mixing.schedule(parts).collect():
        part, period = weights[r["key"]] / total, r["period"]
        slots += r["slots"]
        for c, s in enumerate(r["slots"]):
            worst = max(worst, abs(c - s * part), abs(c + 1 - (s + 1) * part))
        worst = max(worst, abs(len(r["slots"]) - period * part))
    assert sorted(slots) == list(range(period))
    return worst, period


@pytest.mark.parametrize(
    "weights",
    [
        {"1hot": 5000, **{f"1s{i:04d}": 1 for i in range(5000)}},
        {f"1s{i:04d}": 1 + i % 23 for i in range(2000)},
        {"1a": 3001, "1b": 1999, "1c": 7},
    ],
)
def test_less_than_a_block_from_the_given_weights(spark, weights):
    assert furthest(spark, weights)[0] < 1


def test_a_period_that_is_too_long_is_rounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PERIOD", 5000)
    worst, period = furthest(spark, {f"1s{i}": 10_000_019 + i * i for i in range(30)})
    assert worst < 1.5 and abs(period - 5000) <= 30


def test_given_decimal_weights_are_exact(spark):
    docs = spark.createDataFrame([(i, "hot" if i < 400 else f"s{i}") for i in range(1200)], "doc_id long, source string")
    weights = [("hot", 0.5), *((f"s{i}", 0.000625) for i in range(400, 1200))]
    mixed = mixing.mix(docs, spark.createDataFrame(weights, "source string, weight double"), block_rows=1)
    slots = sorted(r["slot"] for r in mixed.where("source = 'hot'").collect())
    assert all(abs(n - slot / 2) < 1 for n, slot in enumerate(slots))


def test_sources_without_weight_take_little(spark):
    rows = [("1a", 3), ("1b", 1), *((f"1z{i}", 0) for i in range(5))]
    found = {r["key"]: r["share"] for r in mixing.shares(spark.createDataFrame(rows, "key string, weight long")).collect()}
    assert found["1a"] == 3 * found["1b"] and all(found[f"1z{i}"] == 1 for i in range(5))
    assert 5 * 1000 <= found["1a"] + found["1b"]

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from tablesync.model import FeedNames
from tablesync.operators import changes as ch
from tablesync.operators import keyed as kd

NAMES = FeedNames("lsn", "seqval", "op")


def feed(spark, entries):
    """Entries are (lsn, seq, op, id, v)."""
    values = [(f"{a:020x}", f"{b:020x}", op, i, v) for a, b, op, i, v in entries]
    return spark.createDataFrame(values, "lsn string, seqval string, op int, id int, v string")


def table(spark, content):
    return spark.createDataFrame(list(content.items()), "id int, v string")


def test_null_keys(spark):
    target = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b")], "id int, v string")
    keys = spark.createDataFrame([(None,), (1,)], "id int")
    assert rows(kd.delete_by_keys(target, keys, "id")) == rows(target.where("id is null or id = 2"))
    assert rows(kd.read_by_keys(target, keys, "id")) == [(1, "a")]
    changes = spark.createDataFrame([(None,), (None,)], "id int")
    assert kd.changed_keys(changes, "id").count() == 0


def test_composite_keys_with_a_null_part(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (1, 3, "c")], "x int, y int, v string")
    keys = spark.createDataFrame([(1, None), (1, 2)], "x int, y int")
    assert rows(kd.delete_by_keys(df, keys, ["x", "y"])) == [(1, 3, "c"), (1, None, "a")]


@pytest.mark.parametrize("broadcast,merge", [(False, False), (True, False), (False, True)])
def test_join_forms_agree(spark, broadcast, merge):
    df = spark.createDataFrame([("it's", 1), ("b", 2)], "k string, v int")
    keys = spark.createDataFrame([("it's",)], "K string")
    assert rows(kd.read_by_keys(df, keys, "k", broadcast, merge)) == [("it's", 1)]
    assert rows(kd.delete_by_keys(df, keys, "k", broadcast, merge)) == [("b", 2)]


def test_binary_keys_and_keys_of_another_type(spark):
    df = spark.createDataFrame([(bytearray(b"\x01"), 1), (bytearray(b"\x02"), 2)], "k binary, v int")
    assert [r["v"] for r in kd.read_by_keys(df, df.where("v = 2").select("k"), "k").collect()] == [2]
    wide = spark.createDataFrame([(1, "a")], "id bigint, v string")
    assert rows(kd.read_by_keys(wide, spark.createDataFrame([("1",)], "ID string"), "id")) == [(1, "a")]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_key_of_the_wrong_type_is_an_error(spark, ansi):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    try:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        with pytest.raises(Exception, match="key id is no int: x"):
            kd.delete_by_keys(df, spark.createDataFrame([("x",)], "id string"), "id").collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_replace_fills_columns_the_source_lacks(spark):
    target = spark.createDataFrame([(1, "old", 7), (2, "keep", 8)], "id int, v string, own int")
    source = spark.createDataFrame([("new", 1, True)], "V string, ID int, extra boolean")
    out = kd.replace_by_keys(target, source, spark.createDataFrame([(1,)], "id int"), "id")
    assert out.columns == target.columns
    assert rows(out) == [(1, "new", None), (2, "keep", 8)]


def test_latest_change_of_a_key(spark):
    entries = [
        (1, 1, 2, 1, "in"), (1, 2, 3, 1, "in"), (1, 3, 4, 1, "upd"), (2, 1, 1, 1, "upd"), (3, 1, 2, 1, "again"),
        (2, 9, 4, 2, "x"), (2, 10, 1, 2, "x"),
        (5, 1, 3, 3, "only before"),
        (4, 1, 4, None, "no key"),
    ]
    latest = kd.latest_changes(feed(spark, entries), "id", NAMES)
    assert sorted((r["id"], r["op"], r["v"]) for r in latest.collect()) == [(1, 2, "again"), (2, 1, "x")]
    out = kd.apply_ops(table(spark, {2: "x", 3: "c"}), feed(spark, entries), "id", NAMES)
    assert rows(out) == [(1, "again"), (3, "c")]


def test_key_update_is_a_delete_and_an_insert(spark):
    entries = [(1, 1, 1, 1, "a"), (1, 2, 2, 2, "a")]
    assert rows(kd.apply_ops(table(spark, {1: "a"}), feed(spark, entries), "id", NAMES)) == [(2, "a")]


def test_measure_keys(spark):
    stats = kd.measure_keys(spark.range(10), "id")
    assert stats.keys == 10 and stats.fits(1000) and not stats.fits(100)
    assert (stats.low, stats.high) == (0, 9)
    assert kd.measure_keys(spark.range(0), "id") == (0, 0, None, None, "bigint")


@pytest.mark.parametrize("sql", ["5", "'b'", "cast(1.5 as decimal(9,2))", "date'2024-01-02'", "X'00ff'", "1.5d",
                                 "timestamp'2024-10-27 02:30:00'", "timestamp_ntz'2024-03-31 02:30:00'", "true"])
def test_key_range_never_loses_a_key(spark, sql):
    df = spark.sql(f"select {sql} as k, 1 as v")
    keys = df.select("k")
    assert kd.read_by_keys(df, keys, "k", True, stats=kd.measure_keys(keys, "k")).count() == 1


def test_lsn_window_on_text_and_binary(spark):
    df = feed(spark, [(1, 1, 2, 1, "a"), (2, 1, 2, 2, "b"), (3, 1, 2, 3, "c")])
    binary = df.withColumn("lsn", F.unhex("lsn"))
    for d in (df, binary):
        assert [r["id"] for r in ch.lsn_window(d, f"{1:020X}", f"{2:020x}", NAMES).collect()] == [2]
        assert ch.lsn_bounds(d, NAMES).first().asDict() == {"min_lsn": f"{1:020x}", "max_lsn": f"{3:020x}"}
        assert ch.bounded_position(d, f"{1:020x}", 1, NAMES).first()["to_lsn"] == f"{2:020x}"
    assert [r["id"] for r in ch.read_changes(df, None, names=NAMES, ordered=True).collect()] == [1, 2, 3]


def test_bootstrap_modes(spark):
    df = feed(spark, [(1, 1, 2, 1, "a"), (1, 2, 2, 2, "b"), (2, 1, 2, 3, "c")])
    assert ch.bootstrap_window(df, None, "parity", NAMES).count() == 1
    assert ch.bootstrap_window(df, None, "all", NAMES).count() == 3
    assert ch.bootstrap_window(df, f"{1:020x}", "all", NAMES).count() == 1
    empty = df.limit(0)
    assert ch.bootstrap_window(empty, None, "parity", NAMES).count() == 0
    assert ch.lsn_bounds(empty, NAMES).first() == (None, None)


def test_summary_counts_null_keys_as_changes_only(spark):
    df = feed(spark, [(1, 1, 2, 1, "a"), (2, 1, 4, 1, "b"), (3, 1, 1, None, "c")])
    assert ch.change_summary(df, "id", NAMES).first().asDict() == {
        "changes": 3, "distinct_keys": 1, "deletes": 1, "inserts": 1, "before_images": 0, "after_images": 1,
        "max_lsn": f"{3:020x}",
    }
    assert ch.change_summary(df.limit(0), "id", NAMES).first()["changes"] == 0


OPS = st.lists(st.tuples(st.sampled_from(["put", "del"]), st.integers(0, 5), st.text("ab", max_size=2)), max_size=25)


def play(start, ops):
    """The source after the operations, and the change entries they leave."""
    now, entries = dict(start), []
    for n, (kind, key, value) in enumerate(ops):
        lsn = n // 3 + 1
        if kind == "put" and key in now:
            entries += [(lsn, 2 * n, 3, key, now[key]), (lsn, 2 * n + 1, 4, key, value)]
            now[key] = value
        elif kind == "put":
            entries.append((lsn, 2 * n, 2, key, value))
            now[key] = value
        elif key in now:
            entries.append((lsn, 2 * n, 1, key, now.pop(key)))
    return now, entries


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(start=st.dictionaries(st.integers(0, 5), st.text("xy", max_size=2)), ops=OPS, cut=st.integers(0, 9))
def test_any_operation_sequence_ends_at_the_source(spark, start, ops, cut):
    now, entries = play(start, ops)
    target, source, changes = table(spark, start), table(spark, now), feed(spark, entries)
    want = sorted(now.items())
    keys = kd.changed_keys(changes, "id")
    once = kd.replace_by_keys(target, source, keys, "id")
    assert rows(once) == want
    assert rows(kd.replace_by_keys(once, source, keys, "id")) == want
    assert rows(kd.apply_ops(target, changes, "id", NAMES)) == want
    first = ch.lsn_window(changes, None, f"{cut:020x}", NAMES)
    second = ch.lsn_window(changes, f"{cut:020x}", None, NAMES)
    assert rows(kd.apply_ops(kd.apply_ops(target, first, "id", NAMES), second, "id", NAMES)) == want




def test_text_keys_get_no_range_filter(spark):
    """A database may order texts by another collation than bytes."""
    df = spark.createDataFrame([("a", 1), ("B", 2), ("c", 3)], "k string, v int")
    keys = df.where("v < 3").select("k")
    found = kd.read_by_keys(df, keys, "k", stats=kd.measure_keys(keys, "k"))
    assert ">=" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 2


def test_positions_keep_the_spelling_of_a_text_feed(spark):
    for spell in (lambda n: f"{n:020X}", lambda n: f"0x{n:020x}"):
        df = spark.createDataFrame([(spell(n), "0", 2, n, "v") for n in range(5, 40)], "lsn string, seqval string, op int, id int, v string")
        assert ch.lsn_window(df, spell(10), None, NAMES).count() == 29

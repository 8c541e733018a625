import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablesync.functions.columns import mark_generated, quoted
from tablesync.model import FeedNames
from tablesync.operators import changes as ch
from tablesync.operators import keyed as kd
from tablesync.operators import verify as vf
from tablesync.sinks.snapshot import SnapshotTarget


def statuses(df, key="id"):
    return {r[key]: r["status"] for r in df.collect()}


@pytest.fixture
def sides(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "NULL"), (4, "d"), (6, "f")], "id int, v string")
    dst = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (5, "e"), (6, "f")], "id int, v string")
    return src, dst


@pytest.mark.parametrize("checksum", ["xxhash64", "md5"])
def test_full_finds_exactly_the_differences(sides, checksum):
    found = statuses(vf.verify_full(*sides, "id", buckets=3, checksum=checksum))
    assert found == {2: "different", 3: "different", 4: "missing_in_dst", 5: "missing_in_src"}


def test_full_of_equal_tables_opens_no_bucket(sides):
    src, _ = sides
    assert vf.verify_full(src, src, "id").count() == 0
    assert vf.differing_buckets(vf.verify_buckets(src, src, "id")).count() == 0
    assert vf.verify_full(src.limit(0), src.limit(0), "id").count() == 0


def test_full_compares_repeated_keys_as_multisets(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "x"), (3, "y")], "id int, v string")
    b = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "x"), (3, "x")], "id int, v string")
    assert statuses(vf.verify_full(a, b, "id")) == {2: "different", 3: "different"}


def test_full_with_a_hot_key(spark):
    base = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"), F.lit("v").alias("v"))
    assert vf.verify_full(base, base, "id").count() == 0
    more = base.unionByName(spark.createDataFrame([(7, "w")], "id bigint, v string"))
    assert statuses(vf.verify_full(more, base, "id")) == {7: "different"}


def test_full_ignores_generated_columns_and_case(spark, sides):
    src, _ = sides
    dst = mark_generated(src.withColumnRenamed("v", "V").withColumn("rv", F.rand()), "rv", "rowversion")
    assert vf.verify_full(src, dst, "ID").count() == 0


def test_full_compares_columns_of_different_types_by_text(spark):
    src = spark.createDataFrame([(1, 5), (2, 6)], "id int, v int")
    dst = spark.createDataFrame([("1", "5"), ("2", "6.0")], "id string, v string")
    assert statuses(vf.verify_full(src, dst, "id")) == {"2": "different"}


def test_full_with_nested_columns_and_composite_key(spark):
    src = spark.sql("select 1 as a, 2 as b, array(1, null) as v union all select 1, 3, array(5)")
    dst = spark.sql("select 1 as a, 2 as b, array(null, 1) as v union all select 1, 3, array(5)")
    assert rows(vf.verify_full(src, dst, ["a", "b"])) == [(1, 2, "different")]


def test_buckets_argument_is_checked(sides):
    with pytest.raises(ValueError, match="buckets"):
        vf.verify_full(*sides, "id", buckets=0)
    with pytest.raises(ValueError, match="checksum"):
        vf.verify_buckets(*sides, "id", checksum="crc")


def test_tail_takes_the_last_keys(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    assert [r["id"] for r in vf.tail_by_key(df, "id", 3).collect()] == [99, 98, 97]
    assert [r["id"] for r in vf.tail_by_key(df.select("id"), "id", 2).collect()] == [99, 98]
    assert vf.tail_by_key(df.limit(0), "id", 3).count() == 0


def test_tail_with_null_and_composite_keys(spark):
    df = spark.createDataFrame([(None, 1, "n"), (1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "x int, y int, v string")
    assert [r["v"] for r in vf.tail_by_key(df, ["x", "y"], 2).collect()] == ["c", "b"]
    assert [r["v"] for r in vf.tail_by_key(df, ["x", "y"], 10).collect()] == ["c", "b", "a", "n"]


def test_tail_summary_counts(sides):
    summary, sample = vf.verify_tail(*sides, "id", 10)
    found = summary.first()
    # 'NULL' and NULL give the same row text in this hash, as specified; only the full check tells them apart
    assert (found["match"], found["mismatches"], found["compared"]) == (False, 2, 4)
    assert [tuple(r) for r in sample.collect()] == [(5, "missing_in_src", 2), (2, "different", 2)]


def test_tail_does_not_see_rows_only_in_the_source(spark, sides):
    src, dst = sides
    same = dst.where("id in (1, 6)")
    assert vf.verify_tail(src, same, "id", 10)[0].first()["match"]


def test_tail_source_with_a_repeated_key_does_not_multiply(spark, sides):
    src, _ = sides
    many = src.unionByName(src.where("id = 6")).unionByName(src.where("id = 6"))
    found = vf.verify_tail(many, src, "id", 2)[0].first()
    assert (found["match"], found["compared"]) == (True, 2)


def test_tail_bounds(sides):
    with pytest.raises(ValueError, match="verify_full"):
        vf.verify_tail_rows(*sides, "id", 100_001)


def test_nothing_to_verify(spark):
    only = mark_generated(spark.createDataFrame([(1,)], "id int"), "id", "identity")
    with pytest.raises(ValueError, match="no columns"):
        vf.verify_full(only, only, "id")


def test_reconcile(sides, spark):
    src, _ = sides
    assert vf.reconcile_counts(src, src).first() == (5, 5, True)
    assert vf.reconcile_counts(src, src.limit(2)).first() == (5, 2, False)
    assert vf.reconcile_counts(src.limit(0), src).first() == (0, 5, True)


def test_any_column_name(spark, folder):
    """Names with dots, quotes and blanks, and names the operators use themselves."""
    names = ["a.b", "c`d", "sp ace", "bucket", "side", "n", "w0", "row_hash", "last", "in_src"]
    src = spark.createDataFrame([tuple(range(i, i + 10)) for i in range(5)], names)
    dst = src.select(*[
        (F.col(quoted(c)) + F.when(F.col("side") == 6, 1).otherwise(0)).alias(c) if c == "bucket" else F.col(quoted(c))
        for c in names
    ])
    for key in ("a.b", "side", "n", ["c`d", "sp ace"]):
        found = vf.verify_full(src, dst, key).collect()
        assert [r["status"] for r in found] == ["different"]
        summary = vf.verify_tail(src, dst, key)[0].first()
        assert (summary["compared"], summary["mismatches"]) == (5, 1)
        target = SnapshotTarget(spark, folder(), key, 2)
        target.overwrite(dst)
        target.replace_by_keys(src, vf.verify_full(src, dst, key).drop("status"))
        assert vf.verify_full(src, target.read(), key).count() == 0
        changes = dst.withColumns({"lsn": F.lit("1"), "seqval": F.lit("1"), "op": F.lit(4)})
        names_of = FeedNames("lsn", "seqval", "op")
        assert vf.verify_full(kd.apply_ops(src, changes, key, names_of), dst, key).count() == 0
        assert ch.change_summary(changes, key, names_of).first()["distinct_keys"] == 5


def test_numbers_of_other_types_are_compared_by_value(spark):
    from tablesync.operators.verify import verify_full, verify_tail_rows

    src = spark.sql("select cast(id as int) id, cast(id + 0.5 as decimal(10,2)) p, cast(id as double) / 3 d from range(20)")
    dst = spark.sql("select id, cast(id + 0.5 as decimal(12,4)) p, cast(id as double) / 3 + 1e-9 d from range(20)")
    assert verify_full(src, dst, "id", float_scale=6).count() == 0
    assert verify_full(src, dst, "id").where("status = 'different'").count() == 20
    assert verify_tail_rows(src, dst, "id", 5, float_scale=6).where("status <> 'match'").count() == 0

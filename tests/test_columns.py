import pytest
from pyspark.sql import functions as F

from tablesync.functions import columns as c


@pytest.fixture
def tables(spark):
    src = spark.createDataFrame([(1, "a", 2.0, 3)], "Name int, ID string, Extra double, seq int")
    dst = spark.createDataFrame([("a", 1, 3, 4)], "id string, NAME int, seq int, gone int")
    return src, c.mark_generated(dst, "seq", "identity")


def test_full_sync_list_puts_key_first_and_drops_identity(tables):
    assert c.full_sync_columns(*tables, "id") == ["ID", "Name", "Extra"]


def test_full_sync_list_keeps_identity_key(tables):
    src, dst = tables
    assert c.full_sync_columns(src, dst, "SEQ")[0] == "seq"


def test_full_sync_list_without_destination(tables):
    assert c.full_sync_columns(tables[0], None, "id") == ["ID", "Name", "Extra", "seq"]


def test_aligned_list_follows_destination(tables):
    assert c.aligned_columns(*tables, "ID") == ["id", "NAME", "seq"]
    assert c.project_aligned(*tables, "ID").first().asDict() == {"id": "a", "NAME": 1, "seq": 3}


def test_missing_key_fails(tables):
    src, dst = tables
    with pytest.raises(ValueError, match="not found"):
        c.full_sync_columns(src, dst, "nothing")
    with pytest.raises(ValueError, match="not found"):
        c.aligned_columns(src.drop("ID"), dst, "id")


def test_verify_list_drops_generated_of_both_sides(tables):
    src, dst = tables
    src = c.mark_generated(src, "name", "rowversion")
    assert c.verify_columns(src, dst, "id") == ["id", "gone"]


def test_verify_list_puts_generated_key_first(tables):
    src, dst = tables
    assert c.verify_columns(src, dst, "seq") == ["seq", "id", "NAME", "gone"]


def test_verify_list_empty_when_all_generated(spark):
    only = c.mark_generated(spark.createDataFrame([(1,)], "id int"), "id", "identity")
    assert c.verify_columns(only, only, "id") == []


def test_names_that_differ_by_case_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "a int, A int")
    with pytest.raises(ValueError, match="ambiguous"):
        c.find_column(df, "a")


def test_schema_checks(tables, spark):
    src, dst = tables
    assert [x.ok for x in c.schema_checks(None, dst, "id")] == [False]
    found = {(x.check, x.column): x.ok for x in c.schema_checks(src, dst, "id")}
    assert found == {
        ("source_exists", None): True, ("key_exists", "id"): True, ("column_in_source", "id"): True,
        ("column_in_source", "NAME"): True, ("column_in_source", "gone"): False,
    }
    assert c.validate_schema(spark, src, dst, "id").where("not ok").count() == 1
    wide = src.withColumn("Name", F.col("Name").cast("bigint"))
    strict = c.schema_checks(wide, dst, "id", strict_types=True)
    assert ("same_type", "NAME", False) in [tuple(x) for x in strict]


def test_column_info_and_metadata(tables, spark):
    info = {r["name"]: r["generated"] for r in c.table_columns(spark, tables[1]).collect()}
    assert info == {"id": None, "NAME": None, "seq": "identity", "gone": None}


def test_strip_metadata_and_hex(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\xff"), 1, "x")], ["__$start_lsn", "__$operation", "v"])
    assert c.strip_metadata(df).columns == ["v"]
    assert c.binary_to_hex(df).first()["__$start_lsn"] == "01ff"


def test_cast_like_fills_missing_columns(tables):
    src, dst = tables
    assert c.cast_like(src, dst.schema).first().asDict() == {"id": "a", "NAME": 1, "seq": 3, "gone": None}


def test_catalogue_marks_generated_columns(spark):
    df = spark.createDataFrame([(1, 2, "a")], "ID int, Version int, v string")
    catalogue = spark.createDataFrame(
        [("id", "identity"), ("VERSION", "rowversion"), ("v", None), ("gone", "identity")], "column_name string, generated string"
    )
    marked = c.mark_from_catalogue(df, catalogue)
    assert [i.generated for i in c.column_info(marked)] == ["identity", "rowversion", None]
    assert marked.collect() == df.collect()
    assert c.mark_from_catalogue(df, catalogue.limit(0)).schema == df.schema
    with pytest.raises(ValueError, match="unknown"):
        c.mark_from_catalogue(df, spark.createDataFrame([("v", "computed")], catalogue.schema))

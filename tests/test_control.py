import datetime

import pytest

from conftest import rows
from tablesync.operators import control as ct

VIEW = """select l.log_id, f.flow_name from logs l left join mappings tm on l.mapping_id = tm.mapping_id
    left join flows f on l.flow_id = f.flow_id {more} order by l.created_at desc, l.log_id desc, f.flow_name limit {n}"""
LITERAL = "or (tm.flow_id is not null and l.flow_id = tm.flow_id)"


@pytest.fixture
def tables(spark):
    flows = spark.createDataFrame(
        [(1, "A", True), (2, "B", True), (3, "C", False)], "flow_id int, flow_name string, is_enabled boolean"
    )
    columns = [f"'{c}' as {c}" for c in ct.VIEW_COLUMNS[2:8]]
    mappings = spark.createDataFrame(
        [(10, 1, True), (11, 2, True), (12, 3, True), (13, 9, True), (14, 1, False)],
        "mapping_id int, flow_id int, is_enabled boolean",
    ).selectExpr("*", *columns)
    day = datetime.datetime(2024, 1, 1)
    entries = [(i, (i * 7) % 4 or None, 10 + i % 6, day + datetime.timedelta(hours=i // 2)) for i in range(20)]
    logs = spark.createDataFrame(entries, "log_id bigint, flow_id int, mapping_id int, created_at timestamp").selectExpr(
        "*", "'CDC' as log_type", "'m' as log_message", "if(log_id % 3 = 0, 'ERROR', 'FAILED') as status",
        "log_id as records_count", "cast(log_id as int) as duration_ms",
    )
    for name, df in (("flows", flows), ("mappings", mappings), ("logs", logs)):
        df.createOrReplaceTempView(name)
    return logs, mappings, flows


@pytest.mark.parametrize("n", [1, 5, 17, 1000])
@pytest.mark.parametrize("literal", [False, True])
def test_recent_logs_like_the_plain_join(spark, tables, n, literal):
    want = spark.sql(VIEW.format(more=LITERAL if literal else "", n=n)).collect()
    got = ct.recent_logs(*tables, n=n, literal=literal).select("log_id", "flow_name").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_literal_without_flows_keeps_the_logs(tables):
    logs, mappings, flows = tables
    assert ct.recent_logs(logs, mappings, flows.limit(0), literal=True).count() == 20


def test_recent_errors_has_only_errors(tables):
    found = ct.recent_errors(*tables, n=3)
    assert found.columns == list(ct.ERROR_COLUMNS)
    assert [r["log_id"] for r in found.collect()] == [18, 15, 12]


def test_enabled_needs_both_sides(tables):
    _, mappings, flows = tables
    assert [r["mapping_id"] for r in ct.enabled_mappings(mappings, flows).orderBy("mapping_id").collect()] == [10, 11]


def test_routes(spark):
    df = spark.createDataFrame(
        [(True, True), (True, False), (False, True), (False, False)], "is_full_sync boolean, cdc_enabled boolean"
    )
    assert [r["action"] for r in ct.route_mappings(df).collect()] == ["FULL_THEN_CDC", "FULL", "CDC", "NONE"]


def test_update_state_keeps_what_is_not_given(spark):
    state = spark.createDataFrame([(1, "a", True), (2, "b", False)], "mapping_id int, lsn string, flag boolean")
    updates = spark.createDataFrame([(1, "z"), (2, None)], "mapping_id int, lsn string")
    assert rows(ct.update_state(state, updates)) == [(1, "z", True), (2, "b", False)]


def test_summary(spark, tables):
    logs, mappings, _ = tables
    got = {r["mapping_id"]: r for r in ct.sync_summary(logs, mappings).collect()}
    assert got[10]["entries"] == 4 and got[10]["errors"] == 4 and got[10]["records"] == 0 + 6 + 12 + 18
    assert got[10]["last_status"] == "ERROR" and got[10]["mean_duration_ms"] == 9.0
    assert got[15]["source_table"] is None


def test_validation_of_many_mappings(spark):
    mappings = spark.createDataFrame([(1, "ID"), (2, "id"), (3, "id")], "mapping_id int, primary_key_column string")
    src = spark.createDataFrame(
        [(1, "id", None), (1, "v", None), (1, "rv", "rowversion"), (2, "v", None)],
        "mapping_id int, column_name string, generated string",
    )
    dst = spark.createDataFrame(
        [(1, "Id", None), (1, "V", None), (1, "RV", None), (1, "w", None), (1, "s", "identity"), (3, "id", None)],
        "mapping_id int, column_name string, generated string",
    )
    assert rows(ct.validate_mappings(mappings, src, dst)) == sorted([
        (1, "source_exists", None, True), (1, "key_exists", "ID", True), (1, "column_in_source", "Id", True),
        (1, "column_in_source", "V", True), (1, "column_in_source", "w", False),
        (2, "source_exists", None, True), (2, "key_exists", "id", False), (3, "source_exists", None, False),
    ], key=repr)

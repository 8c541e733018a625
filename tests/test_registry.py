from conftest import rows
from tablesync.model import SUCCESS, WARNING
from tablesync.operators import registry as rg
from tablesync.plans.jobs import Endpoints, Options, SyncEngine
from test_jobs import NAMES, World

MAPS = "mapping_id int, flow_id int, source_database string, source_schema string, source_table string, cdc_enabled boolean"
TABLES = "database_name string, schema_name string, table_name string, change_table string, registered_at int"


def catalogues(spark, maps, databases, tables):
    return (
        spark.createDataFrame(maps, MAPS), spark.createDataFrame(databases, "database_name string, is_cdc_enabled boolean"),
        spark.createDataFrame(tables, TABLES),
    )


def test_first_registered_one_of_an_enabled_database(spark):
    maps, databases, tables = catalogues(
        spark,
        [(1, 1, "Sales", "dbo", "Orders", True), (2, 1, "Sales", "dbo", "None", True), (3, 1, "Off", "dbo", "T", True),
         (4, 1, "Gone", "dbo", "T", True), (5, 1, "SALES", "DBO", "orders", False), (6, 1, None, "dbo", None, True), (7, 1, "Sales", "x", "Orders", True)],
        [("sales", False), ("SALES", True), ("Off", False), ("unsure", None)],
        [("SALES", "dbo", "ORDERS", "second", 5), ("sales", "dbo", "orders", "first", 4), ("sales", "dbo", "orders", "a tie", 4),
         ("off", "dbo", "t", "unused", 1), ("gone", "dbo", "t", "unused", 1), ("sales", "dbo", "none", None, 1)],
    )
    found = rg.resolve_feeds(maps, databases, tables)
    assert rows(found) == rows(spark.createDataFrame([
        (1, "a tie", 3, "resolved"), (2, None, 0, "table_not_registered"), (3, None, 1, "database_not_enabled"),
        (4, None, 1, "database_not_enabled"), (5, "a tie", 3, "resolved"), (6, None, 0, "database_not_enabled"),
        (7, None, 0, "table_not_registered"),
    ], "a int, b string, c long, d string"))
    warned = {r["mapping_id"]: r["log_message"] for r in rg.feed_warnings(found, maps).collect()}
    assert set(warned) == {1, 2, 3, 4, 6, 7} and warned[1].endswith("reading a tie") and "no change table" in warned[2]


def test_empty_catalogues(spark):
    maps, databases, tables = catalogues(spark, [(1, 1, "a", "b", "c", True)], [], [])
    assert rows(rg.resolve_feeds(maps, databases, tables)) == [(1, None, 0, "database_not_enabled")]
    assert rg.resolve_feeds(maps.limit(0), databases, tables).count() == 0


def test_jobs_read_the_feed_that_the_registry_names(spark, folder):
    world, read = World(spark, folder), []
    maps, databases, tables = catalogues(
        spark, [(1, 7, "s", "dbo", "t", True), (2, 7, "s", "dbo", "u", True)], [("S", True)],
        [("s", "dbo", "t", "late", 2), ("s", "dbo", "t", "early", 1)],
    )

    def feed(mapping, name):
        read.append(name)
        return world.feed()

    registry = rg.FeedRegistry(rg.resolve_feeds(maps, databases, tables), feed)
    engine = SyncEngine(
        spark, world.store, lambda m: Endpoints(world.source, lambda: registry.feed(m), world.target), Options(feed_names=NAMES)
    )
    world.change(1, 3, "c")
    assert [r.status for r in engine.sync_mapping(world.mapping)] == [SUCCESS, SUCCESS]
    assert set(read) == {"early"} and world.in_step()
    from test_jobs import mapping

    assert engine.cdc_sync(mapping(2)).status == WARNING

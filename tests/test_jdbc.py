"""JDBC without a database: options and statements, and the target over tables kept in memory."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablesync.functions.columns import mark_generated
from tablesync.model import SUCCESS, FeedNames, Mapping, TableSpec
from tablesync.operators.keyed import delete_by_keys, read_by_keys
from tablesync.plans.jobs import Endpoints, Options, SyncEngine
from tablesync.sinks import jdbc as sink
from tablesync.sinks.control_store import ControlStore
from tablesync.sources import tables as tb

SPEC = TableSpec("jdbc", "dbo.users", {"url": "jdbc:x", "user": "u", "fetchsize": "500"})


def test_reader_options():
    assert tb.jdbc_options(SPEC)["dbtable"] == "dbo.users"
    assert tb.jdbc_options(SPEC)["preferTimestampNTZ"] == "true"
    split = tb.partitioned_jdbc(SPEC, "UserID", 0, 100, 8).options
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == (
        "UserID", "0", "100", "8"
    )


def test_writer_options_leave_out_the_read_partitioning():
    spec = tb.partitioned_jdbc(SPEC, "UserID", 0, 100, 8)
    assert sink.writer_options(spec, "t") == {
        "url": "jdbc:x", "user": "u", "fetchsize": "500", "numPartitions": "8", "dbtable": "t", "batchsize": "1000",
    }


def test_replace_statements():
    delete, insert = sink.replace_statements("t", "t_keys", "t_rows", ["a", "b"], ["a", "b", "v"])
    assert delete == "DELETE FROM t WHERE EXISTS (SELECT 1 FROM t_keys k WHERE k.a = t.a AND k.b = t.b)"
    assert insert == "INSERT INTO t (a, b, v) SELECT a, b, v FROM t_rows"


def test_small_key_sets_become_a_filter(spark):
    df = spark.range(100).withColumnRenamed("id", "UserID")
    few = spark.createDataFrame([(1,), (2,), (2,), (None,), (500,)], "userid int")
    filtered = tb.read_remote_by_keys(df, few, "UserID")
    assert "IN (1,2,500)" in filtered._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r[0] for r in filtered.collect()) == [1, 2]
    joined = tb.read_remote_by_keys(df, few, "UserID", limit=2)
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(joined.collect()) == sorted(read_by_keys(df, few, "UserID").collect())
    assert tb.read_remote_by_keys(df, few.limit(0), "UserID").count() == 0


class MemoryTarget(sink.JdbcTarget):
    """The database replaced by DataFrames; runs the two kinds of statements the target issues."""

    def __init__(self, spark, table, key):
        super().__init__(spark, TableSpec("jdbc", "t", {}), key)
        self.tables, self.log = {"t": table}, []

    def _load(self, table):
        return self.tables[table]

    def _save(self, df, table, mode):
        df = self.spark.createDataFrame(df.collect(), df.schema)
        self.tables[table] = df if mode == "overwrite" else self.tables[table].unionByName(df)
        return df.count()

    def _execute(self, statements):
        for text in statements:
            self.log.append(text.split(" ")[0])
            if text.startswith("INSERT"):
                self.tables["t"] = self.tables["t"].unionByName(self.tables[text.rsplit(" ", 1)[1]])
            elif "WHERE" not in text:
                self.tables["t"] = self.tables["t"].limit(0)
            else:
                keys = self.tables[re.search(r"FROM (\S+) k", text).group(1)]
                self.tables["t"] = delete_by_keys(self.tables["t"], keys, self.key)


@pytest.fixture
def memory(spark):
    return MemoryTarget(spark, spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string"), "id")


def test_target_replaces_deletes_appends_and_overwrites(spark, memory):
    source = spark.createDataFrame([("bb", 2), ("dd", 4), ("x", 9)], "V string, ID bigint")
    staged = memory.stage_replace(source, spark.createDataFrame([(1,), (2,), (4,)], "id int"))
    assert rows(memory.read()) == [(1, "a"), (2, "b"), (3, "c")]
    assert (staged.keys, staged.deleted, staged.fresh, memory.staged_rows(staged)) == (3, 2, 2, 2)
    memory.publish(staged)
    assert rows(memory.read()) == [(2, "bb"), (3, "c"), (4, "dd")]
    memory.delete_by_keys(spark.createDataFrame([(3,)], "id int"))
    memory.append(spark.createDataFrame([(7, "s")], "id int, v string"))
    assert rows(memory.read()) == [(2, "bb"), (4, "dd"), (7, "s")]
    memory.overwrite(spark.createDataFrame([(5, "e")], "id int, v string"))
    assert rows(memory.read()) == [(5, "e")]
    memory.truncate_and_load(spark.createDataFrame([(6, "f")], "id int, v string"))
    assert rows(memory.read()) == [(6, "f")]


def test_jobs_run_on_a_jdbc_target(spark, memory, folder):
    names = FeedNames("lsn", "seqval", "op")
    now = {1: "a", 8: "h"}
    feed = spark.createDataFrame([(f"{1:020x}", "1", 1, 2)], "lsn string, seqval string, op int, id int")
    ends = Endpoints(lambda: spark.createDataFrame(list(now.items()), "id int, v string"), lambda: feed, memory, True)
    engine = SyncEngine(spark, ControlStore(spark, folder()), lambda m: ends, Options(feed_names=names))
    mapping = Mapping(1, 1, "f", "s", "dbo", "t", "d", "dbo", "t", ("id",), True, True)
    assert engine.cdc_sync(mapping).status == SUCCESS
    assert rows(memory.read()) == [(1, "a"), (3, "c")]
    assert engine.full_sync(mapping).status == SUCCESS
    assert rows(memory.read()) == [(1, "a"), (8, "h")]
    assert engine.verify(mapping).status == SUCCESS
    assert memory.log == ["DELETE", "INSERT"] * 2


class NumberingTarget(MemoryTarget):
    """Numbers the rows of an INSERT that leaves the identity column out, as a database does."""

    saved = ()

    def _save(self, df, table, mode):
        self.saved = [*self.saved, (table, df.columns)]
        return super()._save(df, table, mode)

    def _execute(self, statements):
        staged = self.tables[self.rows_table]
        missing = [c for c in self.tables["t"].columns if c not in staged.columns]
        self.tables[self.rows_table] = staged.select("*", *[F.lit(0).alias(c) for c in missing])
        super()._execute(statements)


@pytest.mark.parametrize("in_place", [False, True])
def test_full_sync_leaves_identity_columns_to_the_database(spark, folder, in_place):
    table = mark_generated(spark.createDataFrame([(1, "a", 7)], "id int, v string, seq int"), "seq", "identity")
    target = NumberingTarget(spark, table, "id")
    source = spark.createDataFrame([(2, "b", 11), (3, "c", 22)], "id int, v string, seq int")
    ends = Endpoints(lambda: source, lambda: None, target)
    engine = SyncEngine(spark, ControlStore(spark, folder()), lambda m: ends, Options(in_place=in_place))
    found = engine.full_sync(Mapping(1, 1, "f", "s", "dbo", "t", "d", "dbo", "t", ("id",), True, False))
    assert (found.status, found.records) == (SUCCESS, 2)
    assert target.saved == [("t" if in_place else "t_sync_rows", ["id", "v"])]
    assert rows(target.read().select("id", "v")) == [(2, "b"), (3, "c")]
    assert target.log == ([] if in_place else ["DELETE", "INSERT"])

"""Replication and control inputs derived from the given tables, in one scan of each.

Whole tables are used throughout. Remainders of a key only decide what happened to a row (changed, deleted, missing in the
copy), never which rows are processed.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.model import FeedNames

KEY = "o_orderkey"
SHORT = FeedNames("start_lsn", "seqval", "operation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lsn_hex(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 20, "0"))


class Replication:
    """Source, stale copy and change feed made of ``orders``; each is built when it is asked for.

    Keys with remainder 3 (mod 10) are missing in the copy, 5 have an old price, 7 are deleted in the source. Remainders
    3 and 7 (mod 20) were changed a second time.
    """

    def __init__(self, orders: DataFrame):
        self.orders = orders

    @cached_property
    def src(self) -> DataFrame:
        return self.orders.where(F.col(KEY) % 10 != 7)

    @cached_property
    def dst(self) -> DataFrame:
        m10, price = F.col(KEY) % 10, F.col("o_totalprice")
        old = F.when(m10 == 5, price - 1).otherwise(price)
        return self.orders.where(m10 != 3).withColumn("o_totalprice", old)

    @cached_property
    def chg(self) -> DataFrame:
        key, price = F.col(KEY), F.col("o_totalprice")
        m10, m20 = key % 10, key % 20

        def op(phase: int, code: int, value: Column) -> Column:
            return F.struct(F.lit(phase).alias("ph"), F.lit(code).alias("operation"), value.alias("price"))

        ops = (
            F.when(m20 == 3, F.array(op(0, 2, price), op(1, 3, price), op(1, 4, price)))
            .when(m10 == 3, F.array(op(0, 2, price)))
            .when(m10 == 5, F.array(op(0, 3, price - 1), op(0, 4, price)))
            .when(m20 == 7, F.array(op(0, 3, price), op(0, 4, price + 1), op(1, 1, price + 1)))
            .when(m10 == 7, F.array(op(1, 1, price)))
        )
        return self.orders.select("*", F.inline(ops)).select(
            lsn_hex((F.floor(key / 100) * 2 + F.col("ph") + 1).cast("bigint")).alias("start_lsn"),
            lsn_hex((key * 2 + F.col("ph")).cast("bigint")).alias("seqval"),
            "operation", KEY, "o_custkey", "o_orderstatus", F.col("price").alias("o_totalprice"),
            "o_orderdate", "o_orderpriority",
        )

    @cached_property
    def from_lsn(self) -> Column:
        """Position in the middle of the feed."""
        return self.orders.agg(lsn_hex(F.floor(F.max(KEY) / 100).cast("bigint"))).scalar()


def replication(spark: SparkSession, sf_dir: str) -> Replication:
    return Replication(table(spark, sf_dir, "orders"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per supplier."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        (k + 1).cast("int").alias("flow_id"),
        F.col("s_name").alias("flow_name"),
        F.concat(F.lit("src-"), k.cast("string")).alias("source_server"),
        F.lit(1433).alias("source_port"),
        F.concat(F.lit("dst-"), k.cast("string")).alias("dest_server"),
        F.lit(1433).alias("dest_port"),
        (k % 5 != 4).alias("is_enabled"),
    )


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping per customer; some point to flows that do not exist."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        (k + 1).cast("int").alias("mapping_id"),
        (k % 120 + 1).cast("int").alias("flow_id"),
        F.lit("srcdb").alias("source_database"),
        F.lit("dbo").alias("source_schema"),
        F.col("c_name").alias("source_table"),
        F.lit("dstdb").alias("dest_database"),
        F.lit("dbo").alias("dest_schema"),
        F.concat("c_name", F.lit("_copy")).alias("dest_table"),
        F.lit("id").alias("primary_key_column"),
        (k % 7 == 0).alias("is_full_sync"),
        (k % 6 != 5).alias("is_enabled"),
        (k % 2 == 0).alias("cdc_enabled"),
        F.when(k % 3 != 0, lsn_hex(k * 16)).alias("last_cdc_lsn"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log entry per event; a third of them belongs to mapping 1, some to mappings that do not exist or to none."""
    e = table(spark, sf_dir, "events")
    k, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    log_type = F.element_at(
        F.array(*[F.lit(t) for t in ("SYNC", "CONNECTION", "FULL_SYNC", "CDC", "VERIFICATION")]), (k % 5 + 1).cast("int")
    )
    status = (
        F.when(kind == "error", "ERROR").when(kind == "purchase", "FAILED").when(kind == "view", "WARNING")
        .when(kind == "signup", "INFO").otherwise("SUCCESS")
    )
    return e.select(
        k.alias("log_id"),
        F.when(k % 11 != 0, F.when(k % 2 == 0, u % 120 + 1).otherwise((k * 7) % 2000 % 120 + 1)).cast("int").alias("flow_id"),
        F.when(k % 13 != 0, F.when(k % 3 == 0, F.lit(1)).otherwise((k * 7) % 2000 + 1)).cast("int").alias("mapping_id"),
        log_type.alias("log_type"),
        F.concat(F.lit("event "), kind).alias("log_message"),
        status.alias("status"),
        F.when(kind == "click", F.floor("value").cast("bigint")).alias("records_count"),
        F.when(kind == "click", (k % 977).cast("int")).alias("duration_ms"),
        F.col("ts").alias("created_at"),
    )


def column_catalogues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source and destination columns of every mapping; some sources, keys and columns are missing."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select("c_custkey", (k + 1).cast("int").alias("mapping_id"))

    def entry(name: str, generated: str | None = None, absent: Column | None = None) -> Column:
        there = F.struct(F.lit(name).alias("column_name"), F.lit(generated).cast("string").alias("generated"))
        return there if absent is None else F.when(~absent, there)

    src = F.filter(F.array(
        entry("id", absent=k % 11 == 0), entry("name"), entry("balance"), entry("segment", absent=k % 9 == 0),
        entry("version", "rowversion"), entry("extra"),
    ), lambda x: x.isNotNull())
    dst = F.array(
        entry("ID"), entry("Name"), entry("balance"), entry("segment"), entry("version"), entry("seq", "identity"),
    )
    return (
        base.where(k % 50 != 49).select("mapping_id", F.inline(src)),
        base.select("mapping_id", F.inline(dst)),
    )


def feed_catalogues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mappings over seven databases, the databases (one is not enabled, one is missing), and the registered change tables.

    Sources have none, one or two change tables; some are registered under names in another case.
    """
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    database = F.concat(F.lit("db"), (k % 7).cast("string"))
    maps = mappings(spark, sf_dir).withColumn("source_database", F.concat(F.lit("db"), ((F.col("mapping_id") - 1) % 7).cast("string")))
    databases = c.where(k % 7 != 5).select(F.upper(database).alias("database_name"), (k % 7 != 3).alias("is_cdc_enabled")).distinct()
    name = F.when(k % 4 == 0, F.upper("c_name")).otherwise(F.col("c_name"))
    instances = F.when(k % 3 == 1, F.array(F.lit(1))).when(k % 3 == 2, F.array(F.lit(2), F.lit(1)))
    tables = c.select(
        database.alias("database_name"), F.lit("DBO").alias("schema_name"), name.alias("table_name"), F.explode(instances).alias("i"), "c_custkey"
    ).select(
        "database_name", "schema_name", "table_name", F.concat_ws("_", F.lit("dbo"), "table_name", "i", F.lit("CT")).alias("change_table"),
        # The second instance of every other table is the older one.
        F.when(k % 2 == 0, F.col("i")).otherwise(-F.col("i")).alias("registered_at"),
    )
    return maps, databases, tables

"""Resolution of change feeds from catalogue tables, for all mappings at once.

A source table has a feed if its database is enabled for change capture and a change table is registered for it. Where several
are registered, the first one counts. Names are compared without case, as the catalogue of a database does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.model import CDC, WARNING, Mapping

# What became of a mapping.
RESOLVED, NOT_ENABLED, NOT_REGISTERED = "resolved", "database_not_enabled", "table_not_registered"

_TABLE = ["database_name", "schema_name", "table_name"]


def first_registered(change_tables: DataFrame) -> DataFrame:
    """(database_name, schema_name, table_name, change_table, registrations): names in lower case, one row a source table.

    Earliest first, ties by name. ``min_by`` combines on the map side, so a table with very many registrations is no
    problem.
    """
    order = F.struct("registered_at", "change_table")
    return change_tables.where(F.col("change_table").isNotNull()).groupBy(*[F.lower(c).alias(c) for c in _TABLE]).agg(
        F.min_by("change_table", order).alias("change_table"), F.count(F.lit(1)).alias("registrations")
    )


def resolve_feeds(mappings: DataFrame, databases: DataFrame, change_tables: DataFrame) -> DataFrame:
    """(mapping_id, change_table, registrations, resolution) of every mapping.

    ``databases``: (database_name, is_cdc_enabled), several rows of one name count as enabled if any is. ``change_tables``:
    (database_name, schema_name, table_name, change_table, registered_at). ``change_table`` is NULL where there is no feed.
    """
    enabled = databases.groupBy(F.lower("database_name").alias("database_name")).agg(
        F.coalesce(F.max("is_cdc_enabled"), F.lit(False)).alias("enabled")
    )
    wanted = mappings.select(
        "mapping_id", F.lower("source_database").alias("database_name"), F.lower("source_schema").alias("schema_name"),
        F.lower("source_table").alias("table_name"),
    )
    found = wanted.join(enabled, "database_name", "left").join(first_registered(change_tables), _TABLE, "left")
    resolution = (
        F.when(~F.coalesce("enabled", F.lit(False)), NOT_ENABLED)
        .when(F.col("change_table").isNull(), NOT_REGISTERED)
        .otherwise(RESOLVED)
    )
    return found.withColumn("resolution", resolution).select(
        "mapping_id", F.when(F.col("resolution") == RESOLVED, F.col("change_table")).alias("change_table"),
        F.coalesce("registrations", F.lit(0)).alias("registrations"), "resolution",
    )


def feed_warnings(resolved: DataFrame, mappings: DataFrame) -> DataFrame:
    """Log rows (flow_id, mapping_id, log_type, status, log_message) of mappings that want a feed and have none, or that have
    several to choose from."""
    table = F.concat_ws(".", "source_database", "source_schema", "source_table")
    message = (
        F.when(F.col("resolution") == NOT_ENABLED, F.concat(F.lit("No feed: capture is off in the database of "), table))
        .when(F.col("resolution") == NOT_REGISTERED, F.concat(F.lit("No feed: no change table is registered for "), table))
        .when(F.col("registrations") > 1, F.concat(
            F.col("registrations").cast("string"), F.lit(" change tables are registered for "), table, F.lit(", reading "), F.col("change_table"),
        ))
    )
    rows = mappings.where("cdc_enabled").join(resolved, "mapping_id").withColumn("log_message", message)
    return rows.where(F.col("log_message").isNotNull()).select(
        "flow_id", "mapping_id", F.lit(CDC).alias("log_type"), F.lit(WARNING).alias("status"), "log_message"
    )


class FeedRegistry:
    """The feeds of a set of mappings, for the endpoints of jobs: one name a mapping, read when the registry is made.

    ``read`` turns the name of a change table into its DataFrame, for the mapping that asks.
    """

    def __init__(self, resolved: DataFrame, read: Callable[[Mapping, str], DataFrame]):
        rows = resolved.where(F.col("change_table").isNotNull()).select("mapping_id", "change_table")
        self.names = {r["mapping_id"]: r["change_table"] for r in rows.toLocalIterator()}
        self._read = read

    def feed(self, mapping: Mapping) -> DataFrame | None:
        name = self.names.get(mapping.mapping_id)
        return None if name is None else self._read(mapping, name)

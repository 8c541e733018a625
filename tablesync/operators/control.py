"""Control-plane operators over flows, mappings, state and logs, and the monitoring views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.model import ERROR, IDENTITY


def enabled_mappings(mappings: DataFrame, flows: DataFrame) -> DataFrame:
    """Mappings that are enabled and whose flow is enabled, with the flow columns needed downstream."""
    on = flows.where("is_enabled").select(
        "flow_id", *[c for c in flows.columns if c not in mappings.columns and c != "flow_id"]
    )
    return mappings.where("is_enabled").join(on, "flow_id").select(
        *mappings.columns, *[c for c in on.columns if c != "flow_id"]
    )


def verifiable_mappings(mappings: DataFrame, running: DataFrame) -> DataFrame:
    """Mappings that are not being processed at the moment."""
    return mappings.join(running.select("mapping_id"), "mapping_id", "left_anti").select(*mappings.columns)


def route_mappings(mappings: DataFrame) -> DataFrame:
    """What to run for a mapping: full sync (then change sync), change sync, or nothing."""
    full, cdc = F.col("is_full_sync"), F.col("cdc_enabled")
    action = (
        F.when(full & cdc, "FULL_THEN_CDC").when(full, "FULL").when(cdc, "CDC").otherwise("NONE")
    )
    return mappings.withColumn("action", action)


def _endpoint(server: str, port: str, database: str) -> Column:
    return F.concat(
        F.lit("server="), F.col(server),
        F.lit(";port="), F.col(port).cast("string"),
        F.lit(";database="), F.col(database),
    )


def mapping_descriptor(mappings: DataFrame, flows: DataFrame) -> DataFrame:
    """Endpoint descriptors of the enabled mappings; credentials are never part of them."""
    return enabled_mappings(mappings, flows).select(
        "mapping_id",
        _endpoint("source_server", "source_port", "source_database").alias("source_descriptor"),
        _endpoint("dest_server", "dest_port", "dest_database").alias("dest_descriptor"),
    )


# Fixed value: format of the subject at the head of every log message.
MESSAGE_HEAD = "Flow '%s': Table mapping '%s' (%s.%s.%s -> %s.%s.%s) - "


def log_messages(mappings: DataFrame, flows: DataFrame, suffix: str) -> DataFrame:
    """``(mapping_id, log_message)`` for the enabled mappings."""
    message = F.concat(
        F.format_string(
            MESSAGE_HEAD,
            "flow_name", "source_table",
            "source_database", "source_schema", "source_table",
            "dest_database", "dest_schema", "dest_table",
        ),
        F.lit(suffix),
    )
    return enabled_mappings(mappings, flows).select("mapping_id", message.alias("log_message"))


def update_state(state: DataFrame, updates: DataFrame, id_column: str = "mapping_id") -> DataFrame:
    """State with the non-NULL values of ``updates`` (at most one row per id) put over it."""
    new = [c for c in updates.columns if c != id_column]
    joined = state.alias("s").join(updates.alias("u"), F.col(f"s.{id_column}") == F.col(f"u.{id_column}"), "left")
    return joined.select(*[
        F.coalesce(F.col(f"u.{c}"), F.col(f"s.{c}")).alias(c) if c in new else F.col(f"s.{c}") for c in state.columns
    ])


def with_states(mappings: DataFrame, states: DataFrame) -> DataFrame:
    """Mappings with what the jobs stored since: requests for a full sync, positions and times of the last runs."""
    known = [c for c in states.columns if c in mappings.columns]
    return update_state(mappings, states.select(known))


# The output columns of the two views.
VIEW_COLUMNS = (
    "log_id", "flow_name", "source_database", "source_schema", "source_table", "dest_database", "dest_schema",
    "dest_table", "log_type", "log_message", "status", "records_count", "duration_ms", "created_at",
)
ERROR_COLUMNS = ("log_id", "flow_name", "source_table", "dest_table", "log_type", "log_message", "created_at")


def _newest(logs: DataFrame, mappings: DataFrame, flows: DataFrame, n: int, literal: bool) -> DataFrame:
    """The newest ``n`` log rows with mapping and flow names.

    Every log row gives at least one result row, so the newest ``n`` logs are enough for the joins: the log table is
    reduced by a top-n before anything is joined, and the lookup tables meet at most ``n`` rows.

    ``literal`` keeps the condition ``log.flow_id = flow.flow_id OR log.flow_id = mapping.flow_id`` of the original
    view: where a log agrees with the flow of its mapping, the second half does not mention the flow, so the row is
    paired with every flow. Only the first ``n`` flow names can reach the result, so they come as one bounded array
    to explode and no nested-loop join is needed.
    """
    order = [F.col("created_at").desc(), F.col("log_id").desc()]
    top = logs.orderBy(*order).limit(n)
    named = top.join(
        mappings.withColumnRenamed("flow_id", "mapping_flow_id").select("mapping_id", "mapping_flow_id", *VIEW_COLUMNS[2:8]),
        "mapping_id",
        "left",
    ).join(flows.select("flow_id", "flow_name"), "flow_id", "left")
    if not literal:
        return named.orderBy(*order).limit(n)
    first_names = flows.select("flow_name").orderBy("flow_name").limit(n)
    every_name = first_names.agg(F.collect_list("flow_name")).scalar()
    names = F.when(F.col("flow_id") == F.col("mapping_flow_id"), every_name).otherwise(F.array("flow_name"))
    fanned = named.withColumn("names", names).drop("flow_name").select("*", F.explode_outer("names").alias("flow_name"))
    return fanned.orderBy(*order, "flow_name").limit(n)


def recent_logs(
    logs: DataFrame, mappings: DataFrame, flows: DataFrame, n: int = 1000, literal: bool = False
) -> DataFrame:
    """Newest logs with flow and mapping details, one row per log unless ``literal``."""
    return _newest(logs, mappings, flows, n, literal).select(*VIEW_COLUMNS)


def recent_errors(
    logs: DataFrame, mappings: DataFrame, flows: DataFrame, n: int = 100, literal: bool = False
) -> DataFrame:
    """Newest logs with status ERROR. Failed verifications have status FAILED and are not part of it."""
    return _newest(logs.where(F.col("status") == ERROR), mappings, flows, n, literal).select(*ERROR_COLUMNS)


def sync_summary(logs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per mapping and log type: last status and time, records, errors, mean duration.

    An aggregation with map-side combine, so a mapping that owns most of the log is no hot spot.
    """
    newest = F.struct("created_at", "log_id")
    per_type = logs.groupBy("mapping_id", "log_type").agg(
        F.count(F.lit(1)).alias("entries"),
        F.max_by("status", newest).alias("last_status"),
        F.max("created_at").alias("last_at"),
        F.coalesce(F.sum("records_count"), F.lit(0)).alias("records"),
        F.count_if(F.col("status") == ERROR).alias("errors"),
        F.avg("duration_ms").alias("mean_duration_ms"),
    )
    return per_type.join(mappings.select("mapping_id", "source_table", "dest_table"), "mapping_id", "left")


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that goes by shuffle whatever its estimate.

    Catalogues hold many rows a mapping, often made by an explode, and compress very well: Catalyst takes millions of them for
    few megabytes and would broadcast them all to every executor. The sorts of a merge join hold one partition, and spill.
    """
    return df.hint("merge")


def generated_columns(mappings: DataFrame, src_columns: DataFrame, dst_columns: DataFrame) -> DataFrame:
    """Destination columns of many mappings with how they are treated, from column catalogues.

    ``(mapping_id, column, src_generated, dst_generated, compared, exported)``: ``compared`` columns take part in the
    verification (generated on neither side), ``exported`` ones in a full sync into a database (in the source, and not
    numbered by the destination; keys always are). Names are compared without case.
    """
    src = src_columns.select(
        "mapping_id", F.lower("column_name").alias("name"), F.col("generated").alias("src_generated"), F.lit(True).alias("there")
    )
    dst = dst_columns.select(
        "mapping_id", F.col("column_name").alias("column"), F.lower("column_name").alias("name"),
        F.col("generated").alias("dst_generated"),
    )
    keys = mappings.select("mapping_id", F.lower("primary_key_column").alias("key_name"))
    numbered = F.coalesce(F.col("dst_generated") == IDENTITY, F.lit(False)) & (F.col("name") != F.col("key_name"))
    known = dst.join(_shuffled(keys), "mapping_id")
    return known.join(_shuffled(src), ["mapping_id", "name"], "left").select(
        "mapping_id", "column", "src_generated", "dst_generated",
        (F.col("src_generated").isNull() & F.col("dst_generated").isNull()).alias("compared"),
        (F.coalesce("there", F.lit(False)) & ~numbered).alias("exported"),
    )


def validate_mappings(mappings: DataFrame, src_columns: DataFrame, dst_columns: DataFrame) -> DataFrame:
    """Schema checks of many mappings at once from column catalogues ``(mapping_id, column_name, generated)``.

    Same rules as ``schema_checks``: ``(mapping_id, check, column, ok)`` for the source, the key and every destination
    column that is generated on neither side. Names are compared without case. The later checks of a mapping appear only
    if its source exists.
    """
    src = src_columns.select("mapping_id", F.lower("column_name").alias("name"), F.col("generated").alias("src_generated"))
    base = mappings.select("mapping_id", "primary_key_column", F.lower("primary_key_column").alias("key_name"))
    per_mapping = (
        base.join(_shuffled(src.withColumn("found", F.lit(True))), "mapping_id", "left")
        .groupBy("mapping_id", "primary_key_column")
        .agg(
            F.count("found").alias("columns"),
            F.count_if(F.col("name") == F.col("key_name")).alias("keys"),
        )
    )
    def check(name: str, column: Column, ok: Column, show: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"), column.alias("column"), ok.alias("ok"), show.alias("show")
        )

    has_columns = F.col("columns") > 0
    head = per_mapping.select("mapping_id", F.inline(F.array(
        check("source_exists", F.lit(None).cast("string"), has_columns, F.lit(True)),
        check("key_exists", F.col("primary_key_column"), F.col("keys") > 0, has_columns),
    ))).where("show").drop("show")
    known = src.select("mapping_id").distinct()
    columns = (
        dst_columns.join(_shuffled(mappings.select("mapping_id")), "mapping_id", "left_semi")
        .join(_shuffled(known), "mapping_id", "left_semi")
        .select("mapping_id", F.col("column_name").alias("column"), F.lower("column_name").alias("name"), "generated")
        .join(_shuffled(src.withColumn("ok", F.lit(True))), ["mapping_id", "name"], "left")
        .where(F.col("generated").isNull() & F.col("src_generated").isNull())
        .select("mapping_id", F.lit("column_in_source").alias("check"), "column",
                F.coalesce("ok", F.lit(False)).alias("ok"))
    )
    return head.unionByName(columns)

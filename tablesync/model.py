"""Names, schemas and small value types shared by the whole package."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import types as T

Key = str | Sequence[str]


class FeedNames(NamedTuple):
    """Column names of the change metadata in a feed."""

    lsn: str = "__$start_lsn"
    seqval: str = "__$seqval"
    operation: str = "__$operation"


DEFAULT_FEED = FeedNames()

# Public change-data-capture convention for the operation column.
OP_DELETE, OP_INSERT, OP_BEFORE, OP_AFTER = 1, 2, 3, 4

# Metadata prefix and width of a log position (10 bytes, as hex text).
META_PREFIX = "__$"
LSN_HEX_DIGITS = 20
ZERO_LSN = "0" * LSN_HEX_DIGITS

# Log types and statuses written to the event log.
SYNC, CONNECTION, FULL_SYNC, CDC, VERIFICATION = "SYNC", "CONNECTION", "FULL_SYNC", "CDC", "VERIFICATION"
INFO, WARNING, ERROR, SUCCESS, FAILED = "INFO", "WARNING", "ERROR", "SUCCESS", "FAILED"

# StructField.metadata entry that marks a generated column: {"generated": "identity" | "rowversion"}.
GENERATED = "generated"
IDENTITY, ROWVERSION = "identity", "rowversion"

FLOW_SCHEMA = T.StructType([
    T.StructField("flow_id", T.IntegerType(), False),
    T.StructField("flow_name", T.StringType(), False),
    T.StructField("source_server", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("dest_server", T.StringType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("is_enabled", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("last_connected_at", T.TimestampType()),
    T.StructField("notes", T.StringType()),
])

MAPPING_SCHEMA = T.StructType([
    T.StructField("mapping_id", T.IntegerType(), False),
    T.StructField("flow_id", T.IntegerType(), False),
    T.StructField("source_database", T.StringType()),
    T.StructField("source_schema", T.StringType()),
    T.StructField("source_table", T.StringType()),
    T.StructField("dest_database", T.StringType()),
    T.StructField("dest_schema", T.StringType()),
    T.StructField("dest_table", T.StringType()),
    T.StructField("primary_key_column", T.StringType()),
    T.StructField("is_full_sync", T.BooleanType()),
    T.StructField("is_enabled", T.BooleanType()),
    T.StructField("cdc_enabled", T.BooleanType()),
    T.StructField("last_cdc_lsn", T.StringType()),
    T.StructField("last_cdc_sync_at", T.TimestampType()),
    T.StructField("last_full_sync_at", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

STATE_SCHEMA = T.StructType([
    T.StructField("mapping_id", T.IntegerType(), False),
    T.StructField("is_full_sync", T.BooleanType()),
    T.StructField("last_cdc_lsn", T.StringType()),
    T.StructField("last_cdc_sync_at", T.TimestampType()),
    T.StructField("last_full_sync_at", T.TimestampType()),
    T.StructField("last_connected_at", T.TimestampType()),
])

LOG_SCHEMA = T.StructType([
    T.StructField("log_id", T.LongType(), False),
    T.StructField("flow_id", T.IntegerType()),
    T.StructField("mapping_id", T.IntegerType()),
    T.StructField("log_type", T.StringType(), False),
    T.StructField("log_message", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("records_count", T.LongType()),
    T.StructField("duration_ms", T.IntegerType()),
    T.StructField("created_at", T.TimestampType(), False),
])


@dataclass(frozen=True)
class TableSpec:
    """Where a table lives: ``format`` is ``parquet``, ``table``, ``jdbc`` or any other batch reader format."""

    format: str
    location: str
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Mapping:
    """One row of the mapping control table as the job runner uses it."""

    mapping_id: int
    flow_id: int
    flow_name: str
    source_database: str
    source_schema: str
    source_table: str
    dest_database: str
    dest_schema: str
    dest_table: str
    key: tuple[str, ...]
    is_full_sync: bool = False
    cdc_enabled: bool = False
    last_cdc_lsn: str | None = None


def key_list(key: Key) -> list[str]:
    """A key is one column name or a sequence of them."""
    names = [key] if isinstance(key, str) else list(key)
    if not names:
        raise ValueError("a table key needs at least one column")
    return names


def quoted(name: str) -> str:
    """A column name as Spark parses it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"

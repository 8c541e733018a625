"""Table scans: files, catalog tables and JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tablesync.functions.columns import find_column, has_column, quoted, resolve_key
from tablesync.model import DEFAULT_FEED, FeedNames, Key, TableSpec
from tablesync.operators.keyed import changed_keys, read_by_keys

# Key sets up to this many rows are sent to a remote database as an IN filter.
PUSHED_KEYS = 10_000


def read_table(spark: SparkSession, spec: TableSpec, columns: list[str] | None = None) -> DataFrame:
    """Full scan with an explicit column list.

    JDBC options are passed through: ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` split
    the read, ``fetchsize`` sizes its batches. Credentials belong into ``options`` at run time, never into control
    tables.
    """
    if spec.format == "table":
        df = spark.read.options(**spec.options).table(spec.location)
    elif spec.format == "jdbc":
        df = spark.read.format("jdbc").options(**jdbc_options(spec)).load()
    else:
        df = spark.read.format(spec.format).options(**spec.options).load(spec.location)
    return df if columns is None else df.select(*[quoted(find_column(df, c)) for c in columns])


def jdbc_options(spec: TableSpec) -> dict[str, str]:
    """Reader options; timestamps without zone stay without zone unless the caller says otherwise."""
    return {"dbtable": spec.location, "preferTimestampNTZ": "true", **spec.options}


def partitioned_jdbc(spec: TableSpec, column: str, lower: int, upper: int, partitions: int) -> TableSpec:
    """The spec with a range-partitioned read on a numeric, date or timestamp column."""
    options = {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }
    return TableSpec(spec.format, spec.location, {**spec.options, **options})


def read_remote_by_keys(table: DataFrame, keys: DataFrame, key: Key, limit: int = PUSHED_KEYS) -> DataFrame:
    """Rows of a remote table whose key is in the set.

    A semi join is not pushed through JDBC. A single-column set of at most ``limit`` keys becomes an IN filter, which
    is. It only saves reading: the typed semi join stays behind it and alone decides, so the rows depend neither on the
    number of keys nor on the collation of the database.
    """
    names = resolve_key(table, key)
    if len(names) == 1:
        few = changed_keys(keys, key).limit(limit + 1).collect()
        if len(few) <= limit:
            values = [row[0] for row in few]
            table = table.where(F.col(quoted(names[0])).isin(values)) if values else table.where(F.lit(False))
    return read_by_keys(table, keys, key)


def table_exists(spark: SparkSession, spec: TableSpec) -> bool:
    """Whether the table can be analysed; other failures (no access, no driver) are raised."""
    if spec.format == "table":
        return spark.catalog.tableExists(spec.location)
    try:
        read_table(spark, spec).schema  # noqa: B018 - analysis only, no job
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "TABLE_OR_VIEW_NOT_FOUND"):
            return False
        raise
    return True


def resolve_feed(
    spark: SparkSession, spec: TableSpec | None, names: FeedNames = DEFAULT_FEED
) -> DataFrame | None:
    """The change feed of a mapping, or None where there is none or it lacks the position column."""
    if spec is None or not table_exists(spark, spec):
        return None
    feed = read_table(spark, spec)
    return feed if has_column(feed, names.lsn) else None


def feed_schema(table_schema: T.StructType, names: FeedNames = DEFAULT_FEED) -> T.StructType:
    """Schema of a change feed with hex-text positions for a table (needed by file streams)."""
    meta = [
        T.StructField(names.lsn, T.StringType()),
        T.StructField(names.seqval, T.StringType()),
        T.StructField(names.operation, T.IntegerType()),
    ]
    return T.StructType(meta + list(table_schema.fields))

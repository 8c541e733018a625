"""JDBC target: load, append and transactional replace by key in a remote database.

Rows travel through the JDBC writer of Spark in parallel, into side tables next to the target. Publishing moves them with
one or two statements in one transaction on one driver connection, so readers never see a table that is emptied but not yet
filled, or a key that is deleted but not yet inserted. The side tables are ``<table>_sync_rows`` and ``<table>_sync_keys``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablesync.functions.columns import cast_like, quoted, resolve_key
from tablesync.model import Key, TableSpec, key_list
from tablesync.operators.keyed import BROADCAST_BYTES, KeyStats, measure_keys, read_by_keys
from tablesync.sinks.snapshot import Staged
from tablesync.sources.tables import read_remote_by_keys, read_table

# Fixed value: rows per commit on bulk import.
BATCH_ROWS = 1000


def writer_options(spec: TableSpec, table: str, batch_size: int = BATCH_ROWS) -> dict[str, str]:
    options = {k: v for k, v in spec.options.items() if k not in ("partitionColumn", "lowerBound", "upperBound")}
    return {**options, "dbtable": table, "batchsize": str(batch_size)}


def overwrite_statements(table: str, rows_table: str, columns: list[str]) -> list[str]:
    """Statements that replace all rows; names are used as the caller quotes them."""
    names = ", ".join(columns)
    return [f"DELETE FROM {table}", f"INSERT INTO {table} ({names}) SELECT {names} FROM {rows_table}"]


def replace_statements(table: str, keys_table: str, rows_table: str, key: Key, columns: list[str]) -> list[str]:
    """Statements of one replace by key."""
    match = " AND ".join(f"k.{c} = {table}.{c}" for c in key_list(key))
    return [
        f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {keys_table} k WHERE {match})",
        overwrite_statements(table, rows_table, columns)[1],
    ]


class JdbcTarget:
    """Target table in a remote database; stands in for a ``SnapshotTarget`` in jobs and in replace-mode streams.

    ``spec.options`` holds url, driver and credentials at run time. The table itself must exist: its definition belongs
    to the database. ``prepare`` are statements run first in every transaction, such as the one that lets explicit identity
    values in.
    """

    def __init__(
        self,
        spark: SparkSession,
        spec: TableSpec,
        key: Key,
        batch_size: int = BATCH_ROWS,
        broadcast_bytes: int = BROADCAST_BYTES,
        count_deleted: bool = True,
        prepare: Sequence[str] = (),
    ):
        self.prepare = list(prepare)
        self.spark, self.spec, self.key, self.batch_size = spark, spec, key_list(key), batch_size
        self.broadcast_bytes, self.count_deleted = broadcast_bytes, count_deleted
        self.rows_table, self.keys_table = f"{spec.location}_sync_rows", f"{spec.location}_sync_keys"

    def exists(self) -> bool:
        return True

    def properties(self) -> dict[str, Any]:
        """A remote table remembers no stream batches; repeating one is harmless in replace mode."""
        return {}

    def read(self) -> DataFrame:
        return self._load(self.spec.location)

    # ---- what touches the database -------------------------------------------------------------------------------

    def _load(self, table: str) -> DataFrame:
        return read_table(self.spark, TableSpec(self.spec.format, table, self.spec.options))

    def _save(self, df: DataFrame, table: str, mode: str) -> int:
        """Write rows; ``overwrite`` truncates a table that is there. Returns their number."""
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("jdbc")
        writer = writer.options(**writer_options(self.spec, table, self.batch_size)).option("truncate", "true")
        writer.mode(mode).save()
        return seen.get.get("rows") or 0

    def _execute(self, statements: list[str]) -> None:
        jvm, options = self.spark._jvm, self.spec.options
        if "driver" in options:
            jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(options["driver"])
        properties = jvm.java.util.Properties()
        for name in ("user", "password"):
            if name in options:
                properties.setProperty(name, options[name])
        connection = jvm.java.sql.DriverManager.getConnection(options["url"], properties)
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for text in statements:
                statement.executeUpdate(text)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    # ---- staging and publishing ----------------------------------------------------------------------------------

    def _staged(self, statements: list[str], fresh: int, **numbers) -> Staged:
        return Staged(0, self.rows_table, {"statements": statements}, 0, fresh, **numbers)

    def stage_overwrite(self, df: DataFrame, properties: dict[str, Any] | None = None) -> Staged:
        rows = self._save(df, self.rows_table, "overwrite")
        return self._staged(overwrite_statements(self.spec.location, self.rows_table, df.columns), rows)

    def stage_replace(
        self,
        source: DataFrame,
        keys: DataFrame,
        properties: dict[str, Any] | None = None,
        stats: KeyStats | None = None,
    ) -> Staged:
        """Load the keys and their current source rows into the side tables."""
        stats = stats or measure_keys(keys, self.key)
        small = stats.fits(self.broadcast_bytes)
        table = self.read()
        names = resolve_key(table, self.key)
        deleted = None
        if self.count_deleted:
            deleted = read_remote_by_keys(table.select(*[quoted(k) for k in names]), keys, self.key).count()
        fresh = cast_like(read_by_keys(source, keys, self.key, small, not small, stats), table.schema)
        self._save(keys.select(*[F.col(quoted(h)).alias(n) for h, n in zip(resolve_key(keys, self.key), names, strict=True)]),
                   self.keys_table, "overwrite")
        rows = self._save(fresh, self.rows_table, "overwrite")
        statements = replace_statements(self.spec.location, self.keys_table, self.rows_table, names, table.columns)
        return self._staged(statements, rows, deleted=deleted, keys=stats.keys)

    def staged_rows(self, staged: Staged) -> int:
        return self._load(self.rows_table).count()

    def publish(self, staged: Staged) -> int:
        self._execute([*self.prepare, *staged.document["statements"]])
        return staged.number

    # ---- one-step forms ------------------------------------------------------------------------------------------

    def _published(self, staged: Staged) -> Staged:
        self.publish(staged)
        return staged

    def overwrite(self, df: DataFrame, properties: dict[str, Any] | None = None) -> Staged:
        return self._published(self.stage_overwrite(df))

    def truncate_and_load(self, df: DataFrame) -> int:
        """Truncate, then load in place: half the writing, but readers see the table fill up."""
        return self._save(df, self.spec.location, "overwrite")

    def append(self, df: DataFrame) -> int:
        """Batched insert."""
        return self._save(df, self.spec.location, "append")

    def replace_by_keys(
        self,
        source: DataFrame,
        keys: DataFrame,
        properties: dict[str, Any] | None = None,
        stats: KeyStats | None = None,
    ) -> Staged:
        return self._published(self.stage_replace(source, keys, properties, stats))

    def delete_by_keys(self, keys: DataFrame) -> Staged:
        return self.replace_by_keys(self.read().limit(0), keys)

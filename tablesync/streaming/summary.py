"""The sync summary kept up from a stream of log rows.

Every batch of new log rows is reduced to partial results per mapping and log type, which can be added up: counts and sums add,
the newest entry is the largest. The summary is the sum of all partials, so reading it costs in proportion to mappings
and batches since the last merge, not to the log. A batch writes into a folder of its own name: one that is delivered twice
replaces its partials instead of adding them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablesync.model import ERROR, LOG_SCHEMA
from tablesync.sources.folders import Folder, VersionedDocument

PARTIAL_SCHEMA = T.StructType([
    T.StructField("mapping_id", T.IntegerType()),
    T.StructField("log_type", T.StringType()),
    T.StructField("entries", T.LongType()),
    T.StructField("records", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("duration_sum", T.LongType()),
    T.StructField("duration_count", T.LongType()),
    T.StructField("last_at", LOG_SCHEMA["created_at"].dataType),
    T.StructField("last_log_id", T.LongType()),
    T.StructField("last_status", T.StringType()),
])
_SUMS = ["entries", "records", "errors", "duration_sum", "duration_count"]
_LAST = ["last_at", "last_log_id", "last_status"]


def partial_summary(logs: DataFrame) -> DataFrame:
    """Log rows reduced to one row per mapping and log type."""
    last = F.max(F.struct(F.col("created_at").alias("last_at"), F.col("log_id").alias("last_log_id"), F.col("status").alias("last_status")))
    return logs.groupBy("mapping_id", "log_type").agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum("records_count"), F.lit(0)).alias("records"),
        F.count_if(F.col("status") == ERROR).alias("errors"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_sum"),
        F.count("duration_ms").alias("duration_count"),
        last.alias("last"),
    ).select("mapping_id", "log_type", *_SUMS, "last.*")


def added_partials(partials: DataFrame) -> DataFrame:
    """Partials added up: one row per mapping and log type again."""
    return partials.groupBy("mapping_id", "log_type").agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.max(F.struct(*_LAST)).alias("last")
    ).select("mapping_id", "log_type", *_SUMS, "last.*")


def summary_of(partials: DataFrame, mappings: DataFrame) -> DataFrame:
    """The view ``sync_summary`` from partials."""
    total = added_partials(partials).select(
        "mapping_id", "log_type", "entries", "last_status", "last_at", "records", "errors",
        (F.col("duration_sum") / F.nullif(F.col("duration_count"), F.lit(0))).alias("mean_duration_ms"),
    )
    return total.join(mappings.select("mapping_id", "source_table", "dest_table"), "mapping_id", "left")


class SummaryStore:
    """Partials of batches under ``root``; every ``merge_every`` batches they are added up into one table.

    Which table counts, and the last batch in it, is published as a numbered document, after the table is written.
    """

    def __init__(self, spark: SparkSession, root: str, merge_every: int = 20):
        self.spark, self.root, self.merge_every = spark, root.rstrip("/"), merge_every
        self._merged = VersionedDocument(Folder(spark, f"{self.root}/merged"))

    def _current(self) -> tuple[int, str | None, int]:
        """Number of the document, the merged folder and the last batch it holds."""
        found = self._merged.current()
        return (found[0], found[1]["folder"], found[1]["batch"]) if found else (-1, None, -1)

    def _batches(self) -> list[int]:
        return sorted(int(n[6:]) for n in Folder(self.spark, f"{self.root}/partials").names() if n.startswith("batch-"))

    def _read(self, folder: str | None, batches: list[int], upto: int | None = None) -> DataFrame:
        paths = [f"{self.root}/partials/batch-{b}" for b in batches if upto is None or b <= upto]
        paths += [f"{self.root}/partials/{folder}"] if folder else []
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], PARTIAL_SCHEMA)

    def partials(self) -> DataFrame:
        _, folder, last = self._current()
        return self._read(folder, [b for b in self._batches() if b > last])

    def summary(self, mappings: DataFrame) -> DataFrame:
        return summary_of(self.partials(), mappings)

    def add(self, logs: DataFrame, batch: int) -> None:
        """Take in the log rows of a batch. Batches come in order; a repeated one changes nothing."""
        number, folder, last = self._current()
        if batch <= last:
            return
        partial_summary(logs).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/partials/batch-{batch}")
        if (batch + 1) % self.merge_every == 0:
            open_ = [b for b in self._batches() if b > last]
            merged = f"upto-{batch}"
            added_partials(self._read(folder, open_, batch)).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/partials/{merged}")
            self._merged.publish(number + 1, {"folder": merged, "batch": batch})
            for name in [f"batch-{b}" for b in open_ if b <= batch] + ([folder] if folder else []):
                Folder(self.spark, f"{self.root}/partials").delete(name)
            self._merged.drop_before(number + 1)


def log_stream(spark: SparkSession, control_root: str, files: int | None = None) -> DataFrame:
    """The log of a control store as a stream. Files that were merged are not read a second time."""
    reader = spark.readStream.schema(LOG_SCHEMA)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(f"{control_root.rstrip('/')}/logs/run=*")


def summary_stream(logs: DataFrame, store: SummaryStore, checkpoint: str, trigger: str | None = "1 minute") -> StreamingQuery:
    """Keep a summary up. One checkpoint belongs to one store, as batches are known by their numbers."""
    writer = logs.writeStream.foreachBatch(store.add).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()

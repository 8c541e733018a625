"""Durable control data of the jobs: sync state per mapping and the event log."""

from __future__ import annotations

import threading
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.model import LOG_SCHEMA, STATE_SCHEMA
from tablesync.sources.folders import Folder, VersionedDocument

WRITER_BITS = 11


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


class ControlStore:
    """State is one small document per mapping (a mapping is run by one job at a time); logs are append-only Parquet.

    Each run writes its log rows into a folder of its own name, so parallel runs do not meet and a repeated run replaces
    its rows instead of adding them twice. :meth:`merge_logs` joins the small files now and then.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 5):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._lock = threading.Lock()
        self._last_id = 0
        self._writer = uuid.uuid4().int % (1 << WRITER_BITS)

    def _document(self, mapping_id: int) -> VersionedDocument:
        return VersionedDocument(Folder(self.spark, f"{self.root}/state/{mapping_id}"))

    def state(self, mapping_id: int) -> dict[str, Any]:
        found = self._document(mapping_id).current()
        return found[1] if found else {}

    def update(self, mapping_id: int, **values: Any) -> dict[str, Any]:
        """Put the non-None values over the stored state and publish it as the next version."""
        document = self._document(mapping_id)
        number, old = document.current() or (-1, {})
        new = {k: v.isoformat() if isinstance(v, datetime) else v for k, v in values.items() if v is not None}
        merged = {**old, **new}
        document.publish(number + 1, merged)
        document.drop_before(number + 2 - self.keep)
        return merged

    def states(self) -> DataFrame:
        """State of all mappings as a DataFrame (one row each): one read of all documents, the last version of each counts."""
        if not Folder(self.spark, f"{self.root}/state").names():
            return self.spark.createDataFrame([], STATE_SCHEMA)
        stored = T.StructType([f for f in STATE_SCHEMA.fields if f.name != "mapping_id"])
        place = F.regexp_extract_all("file", F.lit(r"/(\d+)/(\d+)\.json$"), F.lit(1))
        number = F.regexp_extract("file", r"/(\d+)\.json$", 1).cast("long")
        documents = self.spark.read.schema(stored).options(
            timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", ignoreMissingFiles="true"  # old versions may go meanwhile
        ).json(f"{self.root}/state/*/*.json").select("*", F.col("_metadata.file_path").alias("file"))
        newest = documents.groupBy(place[0].cast("int").alias("mapping_id")).agg(
            F.max_by(F.struct(*stored.fieldNames()), number).alias("s")
        )
        return newest.select("mapping_id", "s.*").select(*STATE_SCHEMA.fieldNames())

    def position(self, mapping_id: int) -> str | None:
        return self.state(mapping_id).get("last_cdc_lsn")

    def _ids(self, n: int) -> list[int]:
        """Log ids that rise with time: microseconds, pushed up where several are taken at once, then the writer.

        The writer is a random number of this store, so that two drivers do not give the same id at the same time.
        """
        with self._lock:
            first = max(int(utc_now().timestamp() * 1_000_000), self._last_id + 1)
            self._last_id = first + n - 1
        return [(i << WRITER_BITS) + self._writer for i in range(first, first + n)]

    def append_logs(self, rows: list[dict[str, Any]], run: str | None = None) -> None:
        """Write the log rows of one run. ``run`` names it where it may be repeated (a stream batch)."""
        if not rows:
            return
        now = utc_now()
        ids = self._ids(len(rows))
        values = [
            [{"log_id": i, "created_at": now, **row}.get(f) for f in LOG_SCHEMA.fieldNames()]
            for i, row in zip(ids, rows, strict=True)
        ]
        df = self.spark.createDataFrame(values, LOG_SCHEMA).coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.root}/logs/run={run or uuid.uuid4().hex}")

    def _merged(self) -> VersionedDocument:
        return VersionedDocument(Folder(self.spark, f"{self.root}/logs_merged"))

    def _log_folders(self) -> tuple[list[str], list[str], list[str]]:
        """Folder of the merged logs (if any), the runs that are not part of it, and leftovers of runs that are."""
        found = self._merged().current()
        merged, covered = ([found[1]["folder"]], set(found[1]["runs"])) if found else ([], set())
        runs = [n for n in Folder(self.spark, f"{self.root}/logs").names() if n.startswith("run=")]
        return merged, [n for n in runs if n not in covered], [n for n in runs if n in covered]

    def _read_logs(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(*[f"{self.root}/logs/{name}" for name in folders])

    def logs(self) -> DataFrame:
        merged, runs, _ = self._log_folders()
        return self._read_logs(merged + runs)

    def merge_logs(self) -> int:
        """Rewrite the small files of the finished runs into few; returns the number of runs taken in.

        The merged folder counts from the moment its document is published, and the runs it covers are left out from
        then on, whether they are deleted already or not.
        """
        merged, runs, leftovers = self._log_folders()
        if not runs:
            return 0
        folder = f"merged-{uuid.uuid4().hex}"
        rows = self._read_logs(merged + runs)
        rows.hint("rebalance").write.parquet(f"{self.root}/logs/{folder}")
        document = self._merged()
        number = (document.numbers() or [-1])[-1] + 1
        document.publish(number, {"folder": folder, "runs": runs + leftovers})
        for name in merged + runs + leftovers:
            Folder(self.spark, f"{self.root}/logs").delete(name)
        document.drop_before(number)
        return len(runs)

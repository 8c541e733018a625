"""Snapshot target: a Parquet table in key buckets whose versions are published atomically.

Layout::

    <root>/data/<folder>/tablesync_bucket=<b>/*.parquet    base rows
    <root>/pending/<folder>/keys, .../rows                 keys replaced since, and their current rows
    <root>/ledger/<folder>/*.parquet                       bucket checksums of a version, if asked for
    <root>/manifest/<n>.json                               which folders make up version n

The table is ``(base without the pending keys) + pending rows``. A small pass only rewrites the pending part, so its cost
does not depend on the size of the table. Once the pending keys outgrow the measured broadcast limit, a pass folds them into
the base: the touched buckets are written into a new folder, untouched ones are not rewritten. The manifest is written last,
so readers see the old table or the new one, never a mixture, and a failed pass leaves the table as it was. One writer per
target at a time; a second one fails on publishing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.columns import cast_like, quoted, resolve_key
from tablesync.model import DEFAULT_FEED, FeedNames, Key, key_list
from tablesync.operators.keyed import (
    BROADCAST_BYTES,
    KeyStats,
    delete_by_keys,
    measure_keys,
    put_rows,
    read_by_keys,
    typed_keys,
)
from tablesync.operators.ledger import LedgerRules, added, bucket_sums
from tablesync.sinks.files import write_keys
from tablesync.sources.folders import Folder, VersionedDocument

BUCKET_COLUMN = "tablesync_bucket"
_FRESH = "tablesync_fresh"


@dataclass(frozen=True)
class Staged:
    """A written but not yet published version."""

    number: int
    path: str | None
    document: dict[str, Any]
    kept: int
    fresh: int
    deleted: int | None = None
    keys: int = 0


class SnapshotTarget:
    """A versioned, bucketed Parquet table.

    ``buckets`` is the unit of rewriting, not of parallelism: a bucket may hold any number of files, and a hot bucket is
    split over many write tasks. Choose it so that a bucket has some hundred MB to some GB. A pass folds the pending part
    into the base when its keys outgrow ``broadcast_bytes`` or its rows ``pending_rows``. ``count_deleted`` counts the rows
    a pass replaces, which takes a scan of the key column of the touched buckets. Old versions stay readable until
    ``vacuum`` is called; with ``keep_versions`` a pass calls it every so many versions, which ends readers of older ones.
    With ``ledger`` every version has a ledger of bucket checksums (see ``operators.ledger``), written before its manifest
    names it; a table written without one gets it by a scan in the next pass.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        key: Key,
        buckets: int = 64,
        broadcast_bytes: int = BROADCAST_BYTES,
        pending_rows: int = 10_000_000,
        compact_every: int = 8,
        count_deleted: bool = True,
        keep_versions: int | None = None,
        ledger: LedgerRules | None = None,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.key = key_list(key)
        self.buckets, self.broadcast_bytes, self.compact_every = buckets, broadcast_bytes, compact_every
        self.pending_rows = pending_rows
        self.count_deleted, self.keep_versions = count_deleted, keep_versions
        self.ledger_rules = ledger
        self._versions = VersionedDocument(Folder(spark, f"{self.root}/manifest"))

    # ---- reading -------------------------------------------------------------------------------------------------

    def exists(self) -> bool:
        return bool(self._versions.numbers())

    def manifest(self) -> tuple[int, dict[str, Any]]:
        found = self._versions.current()
        if found is None:
            raise ValueError(f"no published version under {self.root}")
        return found

    def properties(self) -> dict[str, Any]:
        return self.manifest()[1]["properties"] if self.exists() else {}

    def ledger(self) -> tuple[DataFrame, LedgerRules] | None:
        """Bucket checksums of the published version and their rules, if it has them."""
        return self._ledger(self.manifest()[1])

    def _ledger(self, document: dict[str, Any]) -> tuple[DataFrame, LedgerRules] | None:
        kept = document.get("ledger")
        if not kept:
            return None
        return self.spark.read.parquet(f"{self.root}/ledger/{kept['folder']}"), LedgerRules(**kept["rules"])

    def _write_ledger(self, document: dict[str, Any], parts: list[DataFrame]) -> None:
        """Add up the parts of a ledger: as many rows as buckets at most, in one file."""
        folder = f"l{uuid.uuid4().hex}"
        added(parts).coalesce(1).write.parquet(f"{self.root}/ledger/{folder}")
        document["ledger"] = {"folder": folder, "rules": self.ledger_rules.document()}

    def _keep_ledger(self, old: dict[str, Any], new: dict[str, Any], keys: DataFrame, stats: KeyStats, small: bool) -> None:
        """The ledger of a version that replaces some keys: less their rows in the old version, plus those in the new one."""
        new.pop("ledger", None)
        if not self.ledger_rules:
            return
        kept = self._ledger(old)
        if kept is None or kept[1] != self.ledger_rules:
            self._write_ledger(new, [bucket_sums(self._table(new, range(new["buckets"])), self.key, self.ledger_rules)])
            return
        holding, parts = self._holding(keys, stats, old["buckets"]), [kept[0]]
        for document, sign in ((old, -1), (new, 1)):
            rows = read_by_keys(self._table(document, holding), keys, self.key, small, not small, stats)
            parts.append(bucket_sums(rows, self.key, self.ledger_rules, sign))
        self._write_ledger(new, parts)

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.manifest()[1]["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        """The published table (or one of its earlier versions that is still kept).

        Pending keys are broadcast if their recorded size allows it, which it does unless the limits were changed.
        """
        document = self.manifest()[1] if version is None else self._versions.read(version)
        return self._table(document, range(document["buckets"]))

    def _table(self, document: dict[str, Any], buckets: Iterable[int]) -> DataFrame:
        """Base rows of some buckets without the pending keys, and all pending rows."""
        base = self._base(document, buckets)
        if not document["pending"]:
            return base
        keys, rows = self._pending(document)
        small = self._small(document)
        return delete_by_keys(base, keys, self.key, small, not small).unionByName(rows)

    def _load(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*paths)
        for f in schema.fields:
            if f.metadata:
                df = df.withMetadata(f.name, f.metadata)
        return df

    def _base(self, document: dict[str, Any], buckets: Iterable[int]) -> DataFrame:
        paths = [
            f"{self.root}/data/{folder}/{BUCKET_COLUMN}={b}"
            for b in buckets
            for folder in document["data"].get(str(b), [])
        ]
        return self._load(T.StructType.fromJson(document["schema"]), paths)

    def _pending(self, document: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
        schema, pending = T.StructType.fromJson(document["schema"]), document["pending"]
        key_schema = T.StructType([schema[k] for k in self._key_names(schema)])
        path = f"{self.root}/pending/{pending['folder']}" if pending else None
        return (
            self._load(key_schema, [f"{path}/keys"] if path else []),
            self._load(schema, [f"{path}/rows"] if path else []),
        )

    def _small(self, document: dict[str, Any]) -> bool:
        return document["pending"]["bytes"] <= max(self.broadcast_bytes, BROADCAST_BYTES)

    def _key_names(self, schema: T.StructType) -> list[str]:
        return [next(f.name for f in schema.fields if f.name.lower() == k.lower()) for k in self.key]

    # ---- writing -------------------------------------------------------------------------------------------------

    def _bucket(self, df: DataFrame, buckets: int) -> Column:
        """The hash Spark partitions by, so that a shuffle by key can also be a shuffle by bucket."""
        return F.pmod(F.hash(*[F.col(quoted(k)) for k in resolve_key(df, self.key)]), F.lit(buckets)).cast("int")

    def _touched(self, keys: DataFrame, buckets: int) -> list[int]:
        """The buckets of some keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self._bucket(keys, buckets)).distinct().collect())

    def _holding(self, keys: DataFrame, stats: KeyStats, buckets: int) -> Iterable[int]:
        """Buckets to look for some keys in: those of the keys, or all where so many keys leave hardly one out."""
        return range(buckets) if stats.keys >= 3 * buckets else self._touched(keys, buckets)

    def _aligned(self, buckets: int) -> bool:
        """Whether a task of a shuffle by key holds rows of few buckets only, and needs no second shuffle to write."""
        initial = self.spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
        tasks = int(initial or self.spark.conf.get("spark.sql.shuffle.partitions"))
        return tasks % buckets == 0 or (buckets % tasks == 0 and buckets // tasks <= 16)

    def _write_base(self, parts: list[tuple[DataFrame, bool, bool]], buckets: int) -> tuple[str, list[int], dict]:
        """Write ``(rows, fresh, shuffle)`` parts by bucket; returns the folder, its buckets and exact row counts.

        ``rebalance`` hashes rows by bucket and lets AQE split a bucket that is too big for one task and merge small
        ones. Parts that are clustered by bucket already skip it. The counters sit in the last stage, where a task that
        is run again is not counted twice.
        """
        rows = None
        for df, fresh, shuffle in parts:
            part = df.withColumn(BUCKET_COLUMN, self._bucket(df, buckets))
            if shuffle:
                part = part.hint("rebalance", BUCKET_COLUMN)
            part = part.withColumn(_FRESH, F.lit(fresh))
            rows = part if rows is None else rows.unionByName(part)
        rows, seen = self._observed(rows)
        folder = f"v{uuid.uuid4().hex}"
        by = [BUCKET_COLUMN, *[quoted(k) for k in resolve_key(rows, self.key)]]
        rows.sortWithinPartitions(*by).write.partitionBy(BUCKET_COLUMN).parquet(f"{self.root}/data/{folder}")
        prefix = BUCKET_COLUMN + "="
        names = Folder(self.spark, f"{self.root}/data/{folder}").names()
        return folder, [int(n[len(prefix):]) for n in names if n.startswith(prefix)], _counts(seen)

    @staticmethod
    def _observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
        seen = Observation()
        return rows.observe(
            seen, F.count_if(F.col(_FRESH)).alias("fresh"), F.count_if(~F.col(_FRESH)).alias("kept")
        ).drop(_FRESH), seen

    def _next(self) -> int:
        numbers = self._versions.numbers()
        return numbers[-1] + 1 if numbers else 0

    def stage_overwrite(self, df: DataFrame, properties: dict[str, Any] | None = None) -> Staged:
        """Write a full snapshot without publishing it."""
        resolve_key(df, self.key)
        number = self._next()
        folder, filled, seen = self._write_base([(df, True, True)], self.buckets)
        document = {
            "schema": df.schema.jsonValue(),
            "key": self.key,
            "buckets": self.buckets,
            "data": {str(b): [folder] for b in filled},
            "pending": None,
            "folds": 0,
            "properties": properties or {},
        }
        if self.ledger_rules:
            self._write_ledger(document, [bucket_sums(self._base(document, filled), self.key, self.ledger_rules)])
        return Staged(number, f"{self.root}/data/{folder}", document, 0, seen["fresh"])

    # ---- a snapshot in parts -------------------------------------------------------------------------------------

    def stage_part(self, df: DataFrame) -> dict[str, Any]:
        """Write some rows of a snapshot that is built in parts; what it returns is kept until :meth:`stage_parts`."""
        folder, filled, seen = self._write_base([(df, True, True)], self.buckets)
        return {"folder": folder, "buckets": filled, "exported": seen["fresh"], "rows": self._part_rows(folder, filled)}

    def _part_rows(self, folder: str, filled: list[int]) -> int:
        return self.spark.read.parquet(f"{self.root}/data/{folder}").count() if filled else 0

    def stage_dropped(self, keys: DataFrame) -> str | None:
        """Write keys that the parts must not show; returns their folder, None if there are none."""
        folder = f"d{uuid.uuid4().hex}"
        _, stats = write_keys(keys.hint("rebalance"), self.key, f"{self.root}/pending/{folder}/keys")
        return folder if stats.keys else None

    def has_parts(self, parts: list[dict[str, Any]]) -> bool:
        """Whether all files of some parts are still there (``vacuum`` takes parts that no version names)."""
        return all(
            (not p["buckets"] or Folder(self.spark, f"{self.root}/data/{p['folder']}").has_data())
            and (not p.get("dropped") or Folder(self.spark, f"{self.root}/pending/{p['dropped']}").has_data())
            for p in parts
        )

    def stage_parts(self, schema: T.StructType, parts: list[dict[str, Any]]) -> Staged:
        """A full snapshot made of parts, without publishing it. Dropped keys become pending keys without rows."""
        data: dict[str, list[str]] = {}
        for part in parts:
            for b in part["buckets"]:
                data.setdefault(str(b), []).append(part["folder"])
        document = {
            "schema": schema.jsonValue(), "key": self.key, "buckets": self.buckets, "data": data, "pending": None, "folds": 0,
            "properties": {},
        }
        dropped = [f"{self.root}/pending/{p['dropped']}/keys" for p in parts if p.get("dropped")]
        if dropped:
            keys = self._load(T.StructType([schema[k] for k in self._key_names(schema)]), dropped).distinct()
            nothing = self.spark.createDataFrame([], schema)
            _, document["pending"], _ = self._write_pending(keys, nothing, nothing)
        if self.ledger_rules:
            self._write_ledger(document, [bucket_sums(self._table(document, range(self.buckets)), self.key, self.ledger_rules)])
        return Staged(self._next(), None, document, 0, sum(p["exported"] for p in parts))

    def stage_replace(
        self,
        source: DataFrame,
        keys: DataFrame,
        properties: dict[str, Any] | None = None,
        stats: KeyStats | None = None,
    ) -> Staged:
        """Delete the keys and add their current source rows, in a new unpublished version.

        ``keys`` must be distinct and cheap to read again (a written table); ``stats`` saves measuring them.
        """
        def fresh(schema: T.StructType, stats: KeyStats) -> DataFrame:
            small = stats.fits(self.broadcast_bytes)
            return cast_like(read_by_keys(source, keys, self.key, small, not small, stats), schema)

        same_type = all(
            source.schema[a].dataType == f.dataType
            for a, f in zip(resolve_key(source, self.key), self._key_fields(), strict=True)
        )
        return self._stage(keys, fresh, same_type, properties, stats)

    def stage_ops(
        self,
        latest: DataFrame,
        names: FeedNames = DEFAULT_FEED,
        properties: dict[str, Any] | None = None,
    ) -> Staged:
        """Apply one change per key (see ``latest_changes``) in a new unpublished version."""
        return self._stage(latest, lambda schema, _: put_rows(latest, schema, names), False, properties, None)

    def _key_fields(self) -> list[T.StructField]:
        schema = self.schema()
        return [schema[k] for k in self._key_names(schema)]

    def _stage(
        self, keys: DataFrame, fresh_rows, by_key: bool, properties: dict[str, Any] | None, stats: KeyStats | None
    ) -> Staged:
        """``by_key`` tells that a shuffle join leaves the fresh rows partitioned by the target key."""
        number, document = self._next(), self.manifest()[1]
        new = {**document, "properties": {**document["properties"], **(properties or {})}}
        old_keys, old_rows = self._pending(document)
        keys = typed_keys(keys, old_keys, self.key)
        stats = stats or measure_keys(keys, self.key)
        if stats.keys == 0:
            return Staged(number, None, new, 0, 0, 0, 0)
        small = stats.fits(self.broadcast_bytes)
        deleted = None
        if self.count_deleted:
            have = self._table(document, self._holding(keys, stats, document["buckets"]))
            have = have.select(*[quoted(f.name) for f in self._key_fields()])
            deleted = read_by_keys(have, keys, self.key, small, not small, stats).count()
        fresh = fresh_rows(self.schema(), stats)
        kept = delete_by_keys(old_rows, keys, self.key, small, not small)
        pending = document["pending"] or {"keys": 0, "bytes": 0, "rows": 0}
        total = KeyStats(pending["keys"] + stats.keys, pending["bytes"] + stats.bytes)
        all_keys = keys if not document["pending"] else old_keys.unionByName(keys).distinct()
        if total.fits(self.broadcast_bytes) and pending["rows"] <= self.pending_rows:
            path, new["pending"], seen = self._write_pending(all_keys, kept, fresh)
            self._keep_ledger(document, new, keys, stats, small)
            return Staged(number, f"{path}/rows", new, seen["kept"], seen["fresh"], deleted, stats.keys)
        # Pending and new keys each fit the limit where both are small, so their union stays below twice of it.
        all_small = small and total.fits(2 * self.broadcast_bytes)
        path, seen = self._fold(new, all_keys, [(kept, False, True)], fresh, all_small, by_key)
        self._keep_ledger(document, new, keys, stats, small)
        return Staged(number, path, new, seen["kept"], seen["fresh"], deleted, stats.keys)

    def _write_pending(self, keys: DataFrame, kept: DataFrame, fresh: DataFrame) -> tuple[str, dict, dict]:
        """Few rows: ``rebalance`` gathers them from many scan tasks into files of normal size."""
        folder = f"p{uuid.uuid4().hex}"
        path = f"{self.root}/pending/{folder}"
        rows = kept.withColumn(_FRESH, F.lit(False)).unionByName(fresh.withColumn(_FRESH, F.lit(True)))
        rows, seen = self._observed(rows.hint("rebalance"))
        rows.write.parquet(f"{path}/rows")
        _, stats = write_keys(keys.hint("rebalance"), self.key, f"{path}/keys")
        counts = _counts(seen)
        pending = {"folder": folder, "keys": stats.keys, "bytes": stats.bytes, "rows": counts["kept"] + counts["fresh"]}
        return path, pending, counts

    def _fold(
        self,
        document: dict[str, Any],
        keys: DataFrame,
        rows: list[tuple[DataFrame, bool, bool]],
        fresh: DataFrame | None,
        small: bool,
        by_key: bool,
    ) -> tuple[str, dict]:
        """Write the touched buckets without ``keys`` but with the new rows; updates the document in place.

        Base rows come bucket by bucket from their files. With broadcast keys they are written without a shuffle, with a
        shuffle join after the one of the join if buckets and shuffle partitions are aligned.
        """
        buckets = document["buckets"]
        touched = self._touched(keys, buckets)
        compact = (document["folds"] + 1) % self.compact_every == 0
        aligned = self._aligned(buckets)
        base = delete_by_keys(self._base(document, touched), keys, self.key, small, not small)
        parts = [(base, False, compact or not (small or aligned)), *rows]
        if fresh is not None:
            parts.append((fresh, True, small or not (aligned and by_key)))
        folder, filled, seen = self._write_base(parts, buckets)
        gone = {str(b) for b in touched}
        document["data"] = {b: f for b, f in document["data"].items() if b not in gone} | {
            str(b): [folder] for b in filled
        }
        document["pending"], document["folds"] = None, document["folds"] + 1
        return f"{self.root}/data/{folder}", seen

    def staged_rows(self, staged: Staged) -> int:
        """Rows found in the files a staged version has written (read from the Parquet footers)."""
        if staged.path is None or not Folder(self.spark, staged.path).has_data():
            return 0
        return self.spark.read.parquet(staged.path).count()

    def publish(self, staged: Staged) -> int:
        self._versions.publish(staged.number, staged.document)
        if self.keep_versions and staged.number % self.keep_versions == self.keep_versions - 1:
            self.vacuum(self.keep_versions)
        return staged.number

    # ---- one-step forms ------------------------------------------------------------------------------------------

    def _published(self, staged: Staged) -> Staged:
        self.publish(staged)
        return staged

    def overwrite(self, df: DataFrame, properties: dict[str, Any] | None = None) -> Staged:
        return self._published(self.stage_overwrite(df, properties))

    def replace_by_keys(
        self,
        source: DataFrame,
        keys: DataFrame,
        properties: dict[str, Any] | None = None,
        stats: KeyStats | None = None,
    ) -> Staged:
        return self._published(self.stage_replace(source, keys, properties, stats))

    def delete_by_keys(self, keys: DataFrame, properties: dict[str, Any] | None = None) -> Staged:
        empty = self.spark.createDataFrame([], self.schema())
        return self.replace_by_keys(empty, keys, properties)

    def apply_ops(
        self, latest: DataFrame, names: FeedNames = DEFAULT_FEED, properties: dict[str, Any] | None = None
    ) -> Staged:
        return self._published(self.stage_ops(latest, names, properties))

    def fold(self) -> None:
        """Fold the pending rows into the base."""
        number, document = self._next(), self.manifest()[1]
        if document["pending"]:
            keys, rows = self._pending(document)
            self._fold(document, keys, [(rows, False, True)], None, self._small(document), False)
            self._versions.publish(number, document)

    def append(self, df: DataFrame, properties: dict[str, Any] | None = None) -> Staged:
        """Add rows without looking at the keys that are there; no existing file is rewritten."""
        self.fold()  # a pending key would hide appended base rows
        number, document = self._next(), self.manifest()[1]
        aligned = cast_like(df, T.StructType.fromJson(document["schema"]))
        folder, filled, seen = self._write_base([(aligned, True, True)], document["buckets"])
        data = dict(document["data"])
        for b in map(str, filled):
            data[b] = [*data.get(b, []), folder]
        new = {**document, "data": data, "properties": {**document["properties"], **(properties or {})}}
        kept = self._ledger(document)
        new.pop("ledger", None)
        if self.ledger_rules and kept is not None and kept[1] == self.ledger_rules:
            rows = self._base({**new, "data": {str(b): [folder] for b in filled}}, filled)
            self._write_ledger(new, [kept[0], bucket_sums(rows, self.key, self.ledger_rules)])
        elif self.ledger_rules:
            self._write_ledger(new, [bucket_sums(self._table(new, range(new["buckets"])), self.key, self.ledger_rules)])
        return self._published(Staged(number, f"{self.root}/data/{folder}", new, 0, seen["fresh"]))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove folders that none of the last ``keep`` manifests names (old versions, failed passes).

        Not to be run while a pass is writing to this target.
        """
        numbers = self._versions.numbers()[-max(keep, 1):]
        documents = [self._versions.read(n) for n in numbers]
        used = {f for d in documents for folders in d["data"].values() for f in folders}
        used |= {d["pending"]["folder"] for d in documents if d["pending"]}
        used |= {d["ledger"]["folder"] for d in documents if d.get("ledger")}
        dropped = []
        for place in ("data", "pending", "ledger"):
            folder = Folder(self.spark, f"{self.root}/{place}")
            for name in folder.names():
                if documents and name not in used:
                    folder.delete(name)
                    dropped.append(name)
        if numbers:
            self._versions.drop_before(numbers[0])
        return dropped


def _counts(seen: Observation) -> dict[str, int]:
    found = seen.get
    return {"fresh": found.get("fresh") or 0, "kept": found.get("kept") or 0}

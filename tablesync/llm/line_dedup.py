"""Line dedup over batches of documents, with levelled sorted runs of line hashes.

The runs are a log-structured set of 128-bit line hashes. Every batch is reduced to one row per line (number of its
documents, largest id), merge-anti-joined with the runs, and leaves a run of its own: lines never seen before become
index rows, lines seen before become counts of what this batch adds. As soon as a level holds ``fanout`` runs, they are
merged into one run of the next level, so a batch meets a logarithmic number of runs. Runs are bucketed and sorted by the
hash: a batch is shuffled once, the runs never.

Defined cases: a null or empty text is one empty line; a row without id is a document with the smallest id; rows that
repeat an id are one document, and each of them loses its lines; a line that a document repeats counts once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.llm.common import SPACE, by_batch, restored, shielded, utf8, written
from tablesync.sources.folders import Folder, fresh_folder

STRIP = SPACE.encode()
HASH = ["h1", "h2"]


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the key of a line, or None if the key is shorter than ``min_chars`` code points."""
    key = line_key(line)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def doc_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int, batches: int) -> DataFrame:
    """One row per document and distinct line: doc_id, h1, h2, batch. Documents fall to batches by a hash of the id."""

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [{h for line in t.split(b"\n") if (h := key_hash(line, min_chars))} for t in batch["text"].to_pylist()]
        halves = np.frombuffer(b"".join(h for each in found for h in each), ">i8").reshape(-1, 2).astype("int64")
        out = batch.select(["doc_id", "batch"]).take(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        return out.append_column("h1", halves[:, 0]).append_column("h2", halves[:, 1])

    source = docs.select(
        F.col(doc_id).alias("doc_id"),
        utf8(F.col(text)).alias("text"),
        F.pmod(F.xxhash64(doc_id), F.lit(batches)).cast("int").alias("batch"),
    )
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(by_batch(hashed), f"doc_id {kind}, batch int, h1 long, h2 long")


@dataclass
class Run:
    """One sorted run: a bucketed table (h1, h2, n_docs, max_doc, seen); ``seen``: an older run has the index row."""

    name: str
    path: str
    level: int


@dataclass
class LineRuns:
    """Levelled runs of line hashes in the shared folder."""

    spark: SparkSession
    fanout: int = 2
    buckets: int = 0
    runs: list[Run] = field(default_factory=list)

    def __post_init__(self):
        # As many buckets as a shuffle has partitions: then a batch that is grouped by line is dealt out like the runs.
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, level: int) -> Run:
        run = Run(f"line_run_{uuid.uuid4().hex}", fresh_folder(self.spark, "line-run"), level)
        writer = rows.select(*HASH, "n_docs", "max_doc", "seen").write.format("parquet").option("path", run.path)
        writer.bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(run.name)
        return run

    def _drop(self, run: Run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.name}")
        Folder(self.spark, run.path).delete()

    def add(self, batch: DataFrame) -> None:
        """Take the lines (h1, h2, doc_id) of documents that no earlier batch held."""
        rows = batch.dropDuplicates([*HASH, "doc_id"])
        rows = rows.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        # The merge anti-join: a line without a partner in any run is new. Index rows of the runs are disjoint, so the
        # outer joins keep one row per line, and a line with a partner stays as a count.
        known = [f"known_{i}" for i in range(len(self.runs))]
        for run, flag in zip(self.runs, known, strict=True):
            index = self.spark.table(run.name).where(~F.col("seen")).select(*HASH, F.lit(True).alias(flag))
            rows = rows.join(index.hint("merge"), HASH, "left")
        seen = F.coalesce(*known, F.lit(False)) if known else F.lit(False)
        self.runs.append(self._write(rows.withColumn("seen", seen), 0))
        self.compact()

    def compact(self) -> None:
        """Merge full levels: counts meet the index rows of the merged runs, others stay counts."""
        while full := [lv for lv in {r.level for r in self.runs} if sum(r.level == lv for r in self.runs) >= self.fanout]:
            merged = [r for r in self.runs if r.level == min(full)]
            self.runs = [r for r in self.runs if r.level != min(full)]
            self.runs.append(self._write(self._folded(merged), min(full) + 1))
            for run in merged:
                self._drop(run)

    def _folded(self, runs: list[Run]) -> DataFrame:
        """One row for each line of some runs. A merge of sorted buckets: full outer joins, for which no run is shuffled."""
        rows = self.spark.table(runs[0].name)
        for run in runs[1:]:
            other = self.spark.table(run.name).select(*HASH, *(F.col(c).alias(f"{c}_2") for c in ("n_docs", "max_doc", "seen")))
            rows = rows.join(other.hint("merge"), HASH, "full").select(
                *HASH,
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_docs_2", F.lit(0))).alias("n_docs"),
                F.greatest("max_doc", "max_doc_2").alias("max_doc"),
                (F.coalesce("seen", F.lit(True)) & F.coalesce("seen_2", F.lit(True))).alias("seen"),
            )
        return rows

    def common(self, min_docs: int) -> DataFrame:
        """h1, h2, max_doc of the lines that at least ``min_docs`` documents hold."""
        return self._folded(self.runs).where(F.col("n_docs") >= min_docs).select(*HASH, "max_doc")

    def close(self) -> None:
        """Remove the runs; call it when nothing reads them any more."""
        for run in self.runs:
            self._drop(run)
        self.runs = []


def _kept(texts: pd.Series, dropped: pd.Series, min_chars: pd.Series) -> pd.DataFrame:
    out = []
    for text, drops, least in zip(texts, dropped, min_chars, strict=True):
        lines = text.split(b"\n")
        if drops is None or not len(drops):
            out.append((text.decode("utf-8", "replace"), len(lines), 0))
            continue
        gone = set(map(bytes, drops))
        kept = [x for x in lines if key_hash(x, least) not in gone]
        out.append((b"\n".join(kept).decode("utf-8", "replace"), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """Documents without the lines that at least ``min_docs`` documents hold, but for the largest id that holds them.

    The text column gets the kept lines; ``n_lines`` and ``n_dropped`` are added, or replace columns of these names.
    All other columns pass through. ``batches`` is how many deliveries the documents are taken in; it does not change the result.
    """
    spark = docs.sparkSession
    named, (key, body) = shielded(docs, doc_id, text)
    path = fresh_folder(spark, "lines")
    doc_lines(named, key, body, min_chars, batches).write.partitionBy("batch").parquet(path)
    if Folder(spark, path).has_data():
        lines = spark.read.parquet(path)
        runs = LineRuns(spark, fanout)
        for batch in range(batches):
            runs.add(lines.where(F.col("batch") == batch))
        common = written(runs.common(min_docs), "common-lines")
        runs.close()
        # A line of a third of all documents: only the side of the documents is large, and AQE splits it.
        drops = lines.join(common, HASH).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
        packed = F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in HASH)))
        drops = drops.groupBy("doc_id").agg(F.collect_list(packed).alias("drops"))
        joined = named.join(drops.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("doc_id")), "left")
    else:  # no line is long enough
        joined = named.withColumn("drops", F.lit(None).cast("array<binary>"))
    kept = F.pandas_udf(_kept, "text string, n_lines long, n_dropped long")
    result = joined.withColumn("kept", kept(utf8(F.col(body)), F.col("drops"), F.lit(min_chars)))
    new = {c: F.col(f"kept.{c}") for c in ("text", "n_lines", "n_dropped")}
    return restored(result, docs.columns, {text if c == "text" else c: v for c, v in new.items()})

"""Best-fit packing into sequences of several permitted lengths.

Documents become pieces of at most the largest permitted length. Consecutive pieces, in the order of the input's files and
rows, form groups of a bounded size, and each group is packed in one task: in falling order of length, a piece goes into the
open bin that it fills best; if it fits nowhere, a bin opens whose length costs least for each token it can still be filled
with. Bins are opened for the largest content that pays and in the end shrink to the shortest permitted length that holds it.

Bins keep the order of the input: groups are numbered by their place, the bins of a group by the mean place of their units,
and the rows are returned in this order. So a stretch of bins holds what a stretch of the input holds, its mix of sources say.
Within a group, which is packed as a whole, the order is that of means.

Defined cases: a null or empty text has no characters and takes the room of its end mark; a text longer than the largest
length is cut into pieces of that length, which keep their places; equal lengths are packed in the order of (doc_id, piece);
documents that repeat an id are packed each for itself; an empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesync.llm.common import written

#: Permitted lengths, in code points with the end mark.
LENGTHS = (1024, 2048, 4096, 8192, 16384)
#: Rows of a stretch of a file, within which rows are counted by one task.
ROWS = 4096
#: Bins of a group are numbered from group * this.
BINS = 1 << 24


def bin_cost(length: int) -> float:
    """What a sequence of this length costs: a fixed part, its tokens, and attention that grows with the square."""
    return 256 + length + length * length / 16384


def opening(size: int, left: int, lengths: tuple[int, ...]) -> int:
    """Length to open for a piece, if ``left`` is all that this group has still to place, the piece included."""
    fits = [c for c in lengths if c >= size]
    return min(fits, key=lambda c: (bin_cost(c) / max(size, min(c, left)), c))


def pack(sizes: list[int], lengths: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """Bin, length of the bin and offset for each size; sizes fall and are at most the largest length."""
    lengths = tuple(sorted(lengths))
    room: list[tuple[int, int]] = []  # (free, bin) of open bins, in order
    used: list[int] = []
    left, placed = sum(sizes), []
    for size in sizes:
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, number = room.pop(at)
        else:
            free, number = opening(size, left, lengths), len(used)
            used.append(0)
        placed.append((number, used[number]))
        used[number] += size
        left -= size
        if free > size:
            insort(room, (free - size, number))
    shrunk = [lengths[bisect_left(lengths, n)] for n in used]
    return [(number, shrunk[number], offset) for number, offset in placed]


def placed(docs: DataFrame, size: Column, doc_id: str) -> DataFrame:
    """(doc_id, n, part, file, row): units with the end mark, and the place of each row, by file where rows come right from files.

    Spark reads large files first, so the order in which it reads is not that of the files; other rows count in their order.
    """
    n = (F.coalesce(size, F.lit(0)).cast("long") + 1).alias("n")
    found = [F.col(doc_id).alias("doc_id"), n]
    kind = docs._jdf.queryExecution().analyzed().nodeName()
    if kind.startswith("LogicalRelation") or kind.startswith("Relation"):
        name = F.col("_metadata.file_path")
        number = F.expr("try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) as long)")
        try:
            return docs.select(*found, number.alias("part"), name.alias("file"), F.col("_metadata.row_index").alias("row"))
        except AnalysisException:
            pass  # no rows of Parquet files
    row = F.monotonically_increasing_id()
    return docs.select(*found, F.shiftright(row, 33).alias("part"), F.lit("").alias("file"), row.bitwiseAND((1 << 33) - 1).alias("row"))


def numbered(rows: DataFrame) -> DataFrame:
    """Column ``before``: number of pieces ahead of a row. ``part``, ``file`` and ``row`` give way to it.

    Counted in three steps, so that no task sees more than a stretch of rows, the stretches of a file, or the files.
    """
    ahead = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("file", F.coalesce("file", F.lit(""))).withColumn("stretch", F.expr(f"row div {ROWS}"))
    stretches = written(rows.groupBy("part", "file", "stretch").agg(F.sum("m").alias("m")), "stretches")
    files = stretches.groupBy("part", "file").agg(F.sum("m").alias("m")).withColumn("ahead", ahead(W.orderBy("part", "file")))
    stretches = stretches.withColumn("within", ahead(W.partitionBy("part", "file").orderBy("stretch"))).drop("m")
    same = lambda a, b: a["part"].eqNullSafe(b["part"]) & (a["file"] == b["file"])
    stretches = stretches.join(F.broadcast(files), same(stretches, files)).select(
        stretches["part"], stretches["file"], "stretch", (F.col("within") + F.col("ahead")).alias("first")
    )
    rows = rows.withColumn("inner", ahead(W.partitionBy("part", "file", "stretch").orderBy("row")))
    joined = rows.join(stretches, same(rows, stretches) & (rows["stretch"] == stretches["stretch"]))
    return joined.select("doc_id", "n", (F.col("first") + F.col("inner")).alias("before"))


def pieces(rows: DataFrame, longest: int) -> DataFrame:
    """One row per piece: doc_id, ``piece``, ``start``, ``size`` (with the end mark) and ``place`` among all pieces."""
    last = F.expr(f"cast((n - 1) div {longest} as int)")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * longest
    size = F.least(F.lit(longest).cast("long"), F.col("n") - start).cast("int")
    return rows.select("doc_id", "piece", start.alias("start"), size.alias("size"), (F.col("before") + F.col("piece")).alias("place"))


def pack_documents(
    docs: DataFrame, size: Column | None = None, doc_id: str = "doc_id", text: str = "text",
    lengths: tuple[int, ...] = LENGTHS, group_pieces: int = 20_000,
) -> DataFrame:
    """One row per piece, in the order of bins: doc_id, piece, start, size, bin_id, bin_length, bin_offset.

    ``start`` is the first unit of the document in the piece, ``size`` its units, the last piece with the end mark.
    ``size`` of documents is by default their number of code points. A group of at most ``group_pieces`` consecutive pieces is
    packed by one task; what groups lose against one common packing is at most a few unfilled bins each.
    """
    size = F.length(text) if size is None else size
    # Written first: texts are read once, and places stay the same if a task runs again.
    rows = written(placed(docs, size, doc_id).withColumn("m", F.expr(f"(n - 1) div {max(lengths)} + 1")), "packing-rows")
    total = rows.agg(F.sum("m")).first()[0] or 0
    groups = max(1, -(-total // group_pieces))
    rows = pieces(numbered(rows), max(lengths))

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("place", "ascending")])
        sizes, places = (np.array(group[c].to_pylist(), np.int64) for c in ("size", "place"))
        bins, longs, offsets = (np.array(x, np.int64) for x in zip(*pack(sizes.tolist(), lengths), strict=True))
        # Mean place of the units of a bin; bins of one mean are in the order in which they opened.
        mean = np.bincount(bins, sizes * (places - places.min() + 0.0)) / np.bincount(bins, sizes)
        number = np.empty(len(mean), np.int64)
        number[np.argsort(mean, kind="stable")] = np.arange(len(mean))
        ids = group["group"][0].as_py() * BINS + number[bins]
        out = group.select(["doc_id", "piece", "start", "size"]).append_column("bin_id", pa.array(ids, pa.int64()))
        out = out.append_column("bin_length", pa.array(longs, pa.int32())).append_column("bin_offset", pa.array(offsets, pa.int32()))
        return out.sort_by([("bin_id", "ascending"), ("bin_offset", "ascending")])

    kind = rows.schema["doc_id"].dataType.simpleString()
    # Whole decimals: place times groups may be long. Ranges of groups are also the partitions that tasks pack, in order.
    group = F.expr(f"cast(cast(place as decimal(20,0)) * {groups} div {max(1, total)} as long)")
    return rows.withColumn("group", group).repartitionByRange("group").groupBy("group").applyInArrow(
        packed, f"doc_id {kind}, piece int, start long, size int, bin_id long, bin_length int, bin_offset int"
    )

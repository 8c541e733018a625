"""Hard-negative mining with bounds along spanning trees of the anchors.

Vectors are scaled to whole numbers; the score of a row is its inner product with an anchor. An anchor's positives are its best
rows of the same label, its hard negatives, for each positive, the best rows of other labels whose score lies in a window
relative to that of the positive.

Anchors are dealt to blocks of a bounded number, and every block gets a minimum spanning tree by distance, built in the task of
the block; the trees are a written table. A task scores a candidate y at the root of a tree and walks down: for an edge from
anchor a to its child b, |b.y - a.y| <= |b - a| |y|, so the score at the parent, plus or minus the edge times the norm,
bounds the score at the child. Only candidates whose bounds overlap what can still count there (the best positives so far;
the windows of the negatives and the best in each so far) are rescored; the others pass their bounds on, wider by the edge.
Nothing is lost: bounds are safe against rounding.

A block is read by the driver (``block_anchors`` rows at most) and sent to the tasks by broadcast; candidates are never
shuffled: the tasks scan the written table of rows once for the positives and once for the negatives of a block, and give back
at most k rows an anchor, or an anchor and positive, and task. A window over the anchor, or anchor and positive, merges them.
One label or one group of copies may hold most rows: scans split them as any rows.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no part; nor do
those of another length than the most common one (ties: the longer), or with a scaled vector of norm 2^31 or more, as scores would
not fit a long. Rows that repeat an id are one row, the smallest by label and vector. Ties go to the smaller id. An anchor
without another row of its label has no rows in the result, nor has a positive without a row in its window; a window of a
negative positive score is empty. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesync.llm.common import written

SCALE = 256.0
#: Squared norm below which every inner product of two rows fits a long.
LARGEST = float(1 << 62)
#: Below this bound of inner products sums of doubles are exact.
EXACT = 1 << 53
#: Bounds of a batch of candidates that a task holds (anchors of a block times candidates).
HELD = 1 << 21
NO_SCORE = -(1 << 63)
#: Windows of negatives, in hundredths of the positive's score.
LOW, HIGH = 30, 90


@dataclass
class Block:
    """A block of anchors in tree order: parents lie before their children, the root at 0."""

    number: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    positives: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.int64))


@dataclass
class Counts:
    """How many scores the bounds saved."""

    pairs: int = 0
    scored: int = 0


def usable(vectors: DataFrame, label: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(vec_id, label, x array<long>, norm) of the rows that take part, written; one row an id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.alias("label"), F.col(vector).cast("array<double>").alias("c"))
    good = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND c IS NOT NULL").where(F.coalesce(good, F.lit(False)))
    rows = rows.select("vec_id", "label", F.transform("c", lambda c: F.floor(F.lit(float(scale)) * c).cast("double")).alias("x"))
    rows = rows.withColumn("square", F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)).where(F.col("square") < LARGEST)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", F.col("x").cast("array<long>").alias("x"), "square")).alias("r"))
    rows = written(rows.select("vec_id", "r.label", "r.x", F.sqrt("r.square").alias("norm")), "negatives-rows")
    length = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("x") == (length["n"] if length else 0))


def matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree: parents and edges by place in the order; the root is its own parent."""
    n = len(x)
    x = x.astype(np.float64)
    squares = np.einsum("ij,ij->i", x, x)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    best, nearest, open_ = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    last = 0
    for place in range(n):
        if place:
            last = int(np.argmin(np.where(open_, best, np.inf)))
            parent[place], edge[place] = nearest[last], np.sqrt(((x[last] - x[order[nearest[last]]]) ** 2).sum())
        order[place], open_[last] = last, False
        apart = np.maximum(squares + squares[last] - 2 * (x @ x[last]), 0)
        closer = open_ & (apart < best)
        best[closer], nearest[closer] = apart[closer], place
    return order, parent, edge


def forest(anchors: DataFrame, block_anchors: int = 4096) -> tuple[DataFrame, int]:
    """Spanning trees of the anchors (vec_id, label, x): block, place, vec_id, label, x, parent, edge; and the number of blocks."""
    blocks = max(1, -(-anchors.count() * 5 // (block_anchors * 4)))
    kind = anchors.schema["label"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        x = matrix(group["x"], len(group["x"][0]))
        order, parent, edge = spanning_tree(x)
        out = group.take(pa.array(order)).append_column("place", pa.array(np.arange(len(order)), pa.int32()))
        out = out.append_column("parent", pa.array(parent, pa.int32())).append_column("edge", pa.array(edge))
        return out.select(["block", "place", "vec_id", "label", "x", "parent", "edge"])

    rows = anchors.select("vec_id", "label", "x", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    fields = f"block int, place int, vec_id long, label {kind}, x array<long>, parent int, edge double"
    return written(rows.groupBy("block").applyInArrow(run, fields), "negatives-forest"), blocks


def read_block(trees: DataFrame, number: int) -> Block | None:
    """One block, bounded by the number of anchors dealt to it."""
    table = trees.where(F.col("block") == number).toArrow().sort_by("place")
    if not len(table):
        return None
    x = matrix(table["x"], len(table["x"][0]))
    return Block(number, table["vec_id"].to_numpy(), np.array(table["label"].to_pylist()), x, table["parent"].to_numpy(), table["edge"].to_numpy())


def exact_scores(x: np.ndarray, anchor: np.ndarray, exact_doubles: bool) -> np.ndarray:
    """Inner products of whole numbers as long. Sums of longs may wrap on the way; their result fits."""
    return (x @ anchor).astype(np.int64) if exact_doubles else x.astype(np.int64) @ anchor.astype(np.int64)


class Walk:
    """Walks batches of candidates down the tree of a block; subclasses say what may still count and take in what was rescored."""

    def __init__(self, block: Block):
        self.block, self.counts = block, Counts()
        self.reach = float(np.sqrt((block.vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        self.anchors = block.vectors.astype(np.float64)

    def batch(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        """Candidates in any number; bounds are held for a bounded number of them at a time."""
        step = max(64, HELD // len(self.block.ids))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            self.part(ids[part], labels[part], x[part], norms[part])

    def part(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        block, n = self.block, len(ids)
        exact_doubles = self.reach * float(norms.max(initial=0)) < EXACT / 2
        vectors, x = (self.anchors, x.astype(np.float64)) if exact_doubles else (block.vectors, x)
        low, high = np.empty((len(block.ids), n)), np.empty((len(block.ids), n))
        for a in range(len(block.ids)):
            other = ids != block.ids[a]
            if a:
                # A little more than the bound itself, for rounding of the edge, the norm and large scores.
                slack = block.edge[a] * norms * (1 + 1e-9) + 1
                up = block.parent[a]
                low[a], high[a] = low[up] - slack - np.abs(low[up]) * 1e-12, high[up] + slack + np.abs(high[up]) * 1e-12
                rescore = np.flatnonzero(other & self.overlaps(a, labels, low[a], high[a]))
            else:
                rescore = np.arange(n)
            self.counts.pairs += n
            self.counts.scored += len(rescore)
            if not len(rescore):
                continue
            scores = exact_scores(x if len(rescore) == n else x[rescore], vectors[a], exact_doubles)
            low[a, rescore] = high[a, rescore] = scores
            if not a:
                keep = other & self.overlaps(a, labels, low[a], high[a])
                rescore, scores = np.flatnonzero(keep), scores[keep]
            self.take(a, ids[rescore], scores)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, higher scores first, ties by smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Positives(Walk):
    """The best rows of the label of every anchor."""

    def __init__(self, block: Block, k: int):
        super().__init__(block)
        self.k, self.kept = k, [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in block.ids]
        self.least = np.full(len(block.ids), -np.inf)

    def overlaps(self, a: int, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (labels == self.block.labels[a]) & (high >= self.least[a])

    def take(self, a: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.kept[a][0], ids]), np.concatenate([self.kept[a][1], scores])
        at = best(ids, scores, self.k)
        self.kept[a] = ids[at], scores[at]
        if len(at) == self.k:
            self.least[a] = scores[at[-1]]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(ids) for ids, _ in self.kept]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), *(pa.array(np.concatenate([k[i] for k in self.kept])) for i in (0, 1))],
            names=["place", "vec_id", "score"],
        )


class Negatives(Walk):
    """For every anchor and every distinct score of its positives, the best rows of other labels in the window."""

    def __init__(self, block: Block, k: int, low: int, high: int):
        super().__init__(block)
        self.k = k
        self.windows = [[w for w in map(lambda s: (-(-low * int(s) // 100), high * int(s) // 100), row) if w[0] <= w[1]] for row in block.positives]
        self.windows = [sorted(set(w)) for w in self.windows]
        self.kept = [[(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in w] for w in self.windows]
        # What can still count in any window of an anchor.
        self.low = np.array([min((w[0] for w in ws), default=np.inf) for ws in self.windows], np.float64)
        self.high = np.array([max((w[1] for w in ws), default=-np.inf) for ws in self.windows], np.float64)

    def overlaps(self, a: int, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (labels != self.block.labels[a]) & (high >= self.low[a]) & (low <= self.high[a])

    def take(self, a: int, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = []
        for i, (low, high) in enumerate(self.windows[a]):
            inside = (scores >= low) & (scores <= high)
            kept_ids, kept = self.kept[a][i]
            if inside.any():
                kept_ids, kept = np.concatenate([kept_ids, ids[inside]]), np.concatenate([kept, scores[inside]])
                at = best(kept_ids, kept, self.k)
                kept_ids, kept = kept_ids[at], kept[at]
                self.kept[a][i] = kept_ids, kept
            floor.append(kept[-1] if len(kept) == self.k else low)
        self.low[a] = min(floor)

    def rows(self) -> pa.RecordBatch:
        flat = [(a, w, k) for a, ws in enumerate(self.windows) for w, k in zip(ws, self.kept[a], strict=True) if len(k[0])]
        sizes = [len(k[0]) for *_, k in flat]
        columns = [
            pa.array(np.repeat([a for a, *_ in flat], sizes).astype(np.int32), pa.int32()),
            *(pa.array(np.repeat(np.array([w[i] for _, w, _ in flat], np.int64), sizes), pa.int64()) for i in (0, 1)),
            *(pa.array(np.concatenate([np.empty(0, np.int64), *(k[i] for *_, k in flat)])) for i in (0, 1)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["place", "low", "high", "vec_id", "score"])


def walked(rows: DataFrame, block: Block, kind: type[Walk], settings: tuple, fields: str, report=None) -> DataFrame:
    """What the walks of all tasks give back. The block travels by broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    length = block.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = kind(shared.value, *settings)
        for batch in batches:
            if batch.num_rows:
                labels = np.array(batch.column("label").to_pylist())
                walk.batch(batch.column("vec_id").to_numpy(), labels, matrix(batch.column("x"), length), batch.column("norm").to_numpy())
        if report is not None:
            report[0].add(walk.counts.pairs)
            report[1].add(walk.counts.scored)
        yield walk.rows()

    return rows.mapInArrow(run, fields)


def top(df: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = LOW, high: int = HIGH,
    block_anchors: int = 4096, report=None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over usable rows and anchors among them.

    ``report``: two accumulators, for the pairs of anchor and candidate and for those that were rescored.
    """
    trees, blocks = forest(anchors, block_anchors)
    parts = []
    for number in range(blocks):
        block = read_block(trees, number)
        if block is None:
            continue
        found = walked(rows, block, Positives, (positives,), "place int, vec_id long, score long", report)
        best_rows = written(top(found, ["place"], positives), "negatives-positives")
        # At most ``positives`` rows an anchor of the block.
        scores: list[list[int]] = [[] for _ in block.ids]
        for r in best_rows.collect():
            scores[r["place"]].append(r["score"])
        block.positives = scores
        found = walked(rows, block, Negatives, (negatives, low, high), "place int, low long, high long, vec_id long, score long", report)
        mined = top(found, ["place", "low", "high"], negatives)
        names = trees.where(F.col("block") == number).select("place", F.col("vec_id").alias("anchor_id"))
        ask = best_rows.select(
            "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
            F.expr(f"CAST(ceil(CAST({low} AS DECIMAL(38,0)) * score / 100) AS BIGINT)").alias("low"),
            F.expr(f"CAST(floor(CAST({high} AS DECIMAL(38,0)) * score / 100) AS BIGINT)").alias("high"),
        )
        mined = mined.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(ask, ["place", "low", "high"])
        parts.append(written(mined.join(names, "place").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        ), "negatives"))
    if not parts:
        return rows.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result

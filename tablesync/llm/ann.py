"""Nearest neighbours by largest inner product with vantage-point trees, one tree per shard.

An inner product is no metric. With the largest norm M of all vectors, every vector gets one more coordinate,
sqrt(M^2 - |x|^2), and queries get 0 there: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest vector has the largest inner
product, and distances obey the triangle inequality.

The index is a table: (shard, pos, vec_id, vector, extra, radius). Rows of a shard lie in the order of an implicit tree: the
node over [lo, hi) has its vantage point at lo, the nearer half of the others behind it, the farther half behind that, and
``radius`` is the largest distance in the nearer half. A search visits the side of the vantage point on which a query lies,
then the other one unless |d - radius| > factor * (distance of the k-th best so far). Factor 1 is the triangle inequality
itself, so the search is exact; smaller factors visit less.

Shards have a bounded number of rows (hash of the id), queries go to all shards in blocks of a bounded number: one group of
a shard and a block is one task's unit. Every group returns k rows a query, merged by a window over the query.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or differ in length from the most
common length take no part; a row without id takes none; rows that repeat an id are one vector, the smallest;
ties go to the smaller id; with fewer candidates than k, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesync.llm.common import written

#: Vectors of a subtree that are compared one by one.
LEAF = 128


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector array<double>), one row an id, without the vectors that take no part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(F.coalesce(good, F.lit(False)))
    rows = written(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (length["n"] if length else 0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the first component to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def arrange(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points as an implicit tree, and the radius of every place (NaN where no vantage point lies)."""
    order, radius = np.arange(len(points)), np.full(len(points), np.nan)
    todo = [(0, len(points))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            continue
        # The vantage point: the farthest from the first one, at the rim rather than in the middle.
        own = order[lo:hi]
        far = int(np.argmax(((points[own] - points[own[0]]) ** 2).sum(axis=1)))
        own[0], own[far] = own[far], own[0]
        apart = np.sqrt(((points[own[1:]] - points[own[0]]) ** 2).sum(axis=1))
        by = np.argsort(apart, kind="stable")
        own[1:] = own[1:][by]
        near = middle(lo, hi) - lo - 1
        radius[lo] = apart[by[near - 1]]
        todo += [(lo + 1, lo + 1 + near), (lo + 1 + near, hi)]
    return order, radius


def middle(lo: int, hi: int) -> int:
    """First place of the farther half below the vantage point of [lo, hi)."""
    return lo + 1 + (hi - lo) // 2


def build(vectors: DataFrame, shard_rows: int = 16_384) -> DataFrame:
    """The index of usable vectors, as a written table."""
    n, norm = vectors.agg(F.count(F.lit(1)), F.max(dot(F.col("vector"), F.col("vector")))).first()
    shards = max(1, -(-n // shard_rows))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        found = np.array(group["vector"].to_pylist(), np.float64)
        extra = np.sqrt(np.maximum((norm or 0.0) - np.einsum("ij,ij->i", found, found), 0))
        order, radius = arrange(np.column_stack([found, extra]))
        out = group.select(["shard", "vec_id", "vector"]).take(order)
        out = out.append_column("extra", pa.array(extra[order])).append_column("radius", pa.array(radius))
        return out.add_column(1, "pos", pa.array(np.arange(len(order)), pa.int32()))

    rows = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    fields = "shard int, pos int, vec_id long, vector array<double>, extra double, radius double"
    return written(rows.groupBy("shard").applyInArrow(run, fields), "ann-index")


class Search:
    """A block of queries in one shard; keeps the k best of every query."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, extra: np.ndarray, radius: np.ndarray, k: int, factor: float):
        self.ids, self.points, self.extra, self.radius, self.k, self.factor = ids, points, extra, radius, k, factor

    def run(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        self.query_ids, self.queries = query_ids, queries
        self.squares = np.einsum("ij,ij->i", queries, queries)
        self.best = [(np.empty(0), np.empty(0, np.int64)) for _ in query_ids]
        self.worst = np.full(len(query_ids), -np.inf)  # inner product of the k-th best
        self.limit = (self.extra**2 + np.einsum("ij,ij->i", self.points, self.points)).max(initial=0)
        self.visit(0, len(self.ids), np.arange(len(query_ids)))
        return [b[0] for b in self.best], [b[1] for b in self.best]

    def visit(self, lo: int, hi: int, active: np.ndarray) -> None:
        if not len(active) or hi <= lo:
            return
        if np.isnan(self.radius[lo]):
            self.compare(lo, hi, active)
            return
        self.compare(lo, lo + 1, active)
        products = self.queries[active] @ self.points[lo]
        # The query has 0 where the vantage point has its extra coordinate.
        square = np.einsum("j,j->", self.points[lo], self.points[lo]) + self.extra[lo] ** 2
        apart = np.sqrt(np.maximum(self.squares[active] + square - 2 * products, 0))
        mid, inside = middle(lo, hi), apart <= self.radius[lo]
        near, far = (lo + 1, mid), (mid, hi)
        self.visit(*near, active[inside])
        self.visit(*far, active[~inside])
        margin = np.abs(apart - self.radius[lo])
        reach = np.sqrt(np.maximum(self.squares[active] + self.limit - 2 * self.worst[active], 0))
        open_ = margin <= self.factor * reach + 1e-9
        self.visit(*far, active[inside & open_])
        self.visit(*near, active[~inside & open_])

    def compare(self, lo: int, hi: int, active: np.ndarray) -> None:
        points, ids = self.points[lo:hi], self.ids[lo:hi]
        rough = self.queries[active] @ points.T
        # Rounding of a matrix product depends on the place of a row; what may count is computed again, one by one.
        worst = self.worst[active]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(worst), worst, 0)))
        wanted = rough >= (worst - slack)[:, None]
        for row in np.flatnonzero(wanted.any(axis=1)):
            q = active[row]
            at = np.flatnonzero(wanted[row])
            at = at[ids[at] != self.query_ids[q]]
            exact = np.einsum("ij,j->i", points[at], self.queries[q])
            scores = np.concatenate([self.best[q][0], exact])
            found = np.concatenate([self.best[q][1], ids[at]])
            order = np.lexsort((found, -scores))[: self.k]
            self.best[q] = scores[order], found[order]
            if len(order) == self.k:
                self.worst[q] = scores[order[-1]]


def search(index: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, block_rows: int = 2048) -> DataFrame:
    """The k best of every query (vec_id, vector) but itself: query_id, rank, vec_id, score."""
    shards = index.agg(F.max("shard")).first()[0] or 0
    blocks = max(1, -(-queries.count() // block_rows))

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        fields = pa.schema({"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()})
        if not len(vectors) or not len(asked):
            return fields.empty_table()
        vectors, asked = vectors.sort_by("pos"), asked.sort_by("query_id")
        matrix = np.array(vectors["vector"].to_pylist(), np.float64)
        tree = Search(vectors["vec_id"].to_numpy(), matrix, vectors["extra"].to_numpy(), vectors["radius"].to_numpy(), k, factor)
        names = asked["query_id"].to_numpy()
        scores, ids = tree.run(names, np.array(asked["query"].to_pylist(), np.float64))
        counts = [len(x) for x in ids]
        columns = [np.repeat(names, counts), np.concatenate(ids), np.concatenate(scores)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).withColumn("block", block)
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(
        run, "query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Near-duplicate documents by min-max hashing: classes of documents whose shingle sets are similar, directly or in a chain.

Each permutation of the shingle hashes gives two values of a signature, its minimum and its maximum, both equal for two sets
with a probability of their similarity: half the hash evaluations of a signature of minima alone, and an estimate from
both has a lower variance. ``ROWS`` values make a band, minima and maxima apart; documents that share a band are candidates.
With 24 bands of 4 values, a pair of similarity 0.85 misses all bands with a probability of 2e-8, one of 0.8 with 3e-6.

1. Documents of one shingle set are one node, known by the 128-bit digest of the set.
2. Every bucket (the nodes that share a band) links its nodes to its least one - a star, not all pairs. Links are confirmed
   on the full sets. Connected components follow.
3. What stars leave open are buckets whose other nodes lie in several components. They are dealt into blocks of a bounded
   size; each pair of blocks is one unit of work that compares full sets across components and returns only links that
   join two of them. So the result is exact for all pairs that share a band, and no pair is written that is not a link.

Defined cases: null and empty texts, and texts of white space, have an empty set and are linked with nothing, not even with
each other; a text with fewer words than a shingle has its whole sequence as its only shingle; rows that repeat an id are
looked at each for itself, and the smallest id of a class names it; a row without id is linked with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import by_batch, mix, odd_numbers, shielded, shingles, utf8, written

PERMUTATIONS = 48
ROWS = 4
#: Nodes and shingles of a block of an open bucket.
BLOCK_NODES = 1024
BLOCK_ITEMS = 1 << 20
#: Ids that a join may broadcast.
BROADCAST_IDS = 1_000_000
#: Shingles permuted at a time: bounds the memory of very long texts.
CHUNK = 4096
_FACTORS = odd_numbers(PERMUTATIONS, 11)[:, None]
_MASKS = odd_numbers(PERMUTATIONS, 12)[:, None]


def signature(found: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of all permutations of a non-empty set of hashes."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(found), CHUNK):
        permuted = (found[None, at : at + CHUNK] ^ _MASKS) * _FACTORS
        low, high = np.minimum(low, permuted.min(axis=1)), np.maximum(high, permuted.max(axis=1))
    return np.concatenate([low, high])


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band; the number of the band is part of it."""
    grouped = values.reshape(-1, ROWS)
    total = np.arange(1, len(grouped) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column, factor in zip(grouped.T, odd_numbers(ROWS, 13), strict=True):
        total = mix(total ^ column) * factor
    return mix(total).view(np.int64)


def digest_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.astype("<u8").tobytes())


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, digest, bands) of every row: set size, digest of the set, band hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, hashes = [], [], []
        for body in batch["text"].to_pylist():
            found = shingles(body, k)
            sizes.append(len(found))
            digests.append(digest_of(found) if len(found) else None)
            hashes.append(bands(signature(found)) if len(found) else None)
        columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(by_batch(run), f"doc_id {kind}, n long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(node, items) of the documents in ``ids``: sorted little-endian 64-bit hashes of their sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(body, k) for body in batch["text"].to_pylist()]
        columns = [[digest_of(x) for x in found], [x.astype("<u8").tobytes() for x in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["node", "items"])

    # Ids of a checked number travel to the texts; beyond it, the texts are shuffled to the ids.
    small = ids.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").select(utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(by_batch(run), "node binary, items binary")


def similar(a: np.ndarray, b: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with intersections ``both`` have 100 * intersection >= percent * union."""
    return 100 * both >= percent * (a + b - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are links."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for a, b in zip(batch["items_a"].to_pylist(), batch["items_b"].to_pylist(), strict=True):
            a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            keep.append(bool(similar(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), percent)))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    return rows.select("a", "b", "items_a", "items_b").mapInArrow(by_batch(run), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all ends of the links (a, b): the least node reachable.

    In every round a node takes the least label around it, or the label of that label if it is less, so long chains
    shrink fast. The rounds end when no label changes; each is written, so none depends on executors that are gone.
    """
    links = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = written(labels.select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        around = links.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b")
        around = around.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        beyond = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        step = labels.join(around, "node").join(beyond, "near", "left")
        step = written(step.select("node", "component", F.least("component", "near", "far").alias("next")), "labels")
        labels = step.select("node", F.col("next").alias("component"))
        if step.where("next < component").isEmpty():
            return labels


def block_links(group: pa.Table, percent: int) -> pa.Table:
    """Links across components between the blocks ``i`` and ``j`` of a bucket, as few as join the components.

    Shingles of one node alone add nothing to an intersection, so only the others become columns of a 0/1 matrix.
    """
    blocks, nodes, labels = (group[c].to_pylist() for c in ("block", "node", "component"))
    sets = [np.frombuffer(x, "<u8") for x in group["items"].to_pylist()]
    sizes = np.array([len(s) for s in sets])
    rows, items = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    found, place, count = np.unique(items, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    rows, columns = rows[count[place] > 1], rank[place[count[place] > 1]]
    by = np.argsort(columns, kind="stable")
    rows, columns = rows[by], columns[by]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int((count > 1).sum()), CHUNK):
        some = slice(*np.searchsorted(columns, [at, at + CHUNK]))
        part = np.zeros((len(sets), CHUNK), np.float32)
        part[rows[some], columns[some] - at] = 1
        both += part @ part.T
    parent = {c: c for c in labels}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    number = np.unique(labels, return_inverse=True)[1]
    linked = np.triu(similar(sizes[:, None], sizes[None, :], both.astype(np.int64), percent), 1)
    linked &= number[:, None] != number[None, :]
    first, second = group["i"][0].as_py(), group["j"][0].as_py()
    for x, y in zip(*np.nonzero(linked), strict=True):
        if first == second or blocks[x] != blocks[y]:
            a, b = root(labels[x]), root(labels[y])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((nodes[x], nodes[y]))
    return pa.Table.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], ["a", "b"])


def open_links(shared: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that stars have not seen: between nodes of a bucket, other than its least one, in different components."""
    rest = shared.where("least < node").join(labels, "node", "left")
    rest = rest.withColumn("component", F.coalesce("component", "node")).select("band", "node", "n", "component")
    size = rest.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("items")
    ).where("low < high")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
    rows = rest.join(size.select("band", blocks.alias("blocks")), "band")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = rows.join(sets, "node").select("band", "i", "j", "block", "node", "component", "items")
    return rows.groupBy("band", "i", "j").applyInArrow(lambda group: block_links(group, percent), "a binary, b binary")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable, itself included), kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of shingles of ``k`` words.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketch = written(sketches(docs, k), "sketches")
    known = sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # Copies fall together first; partial aggregation takes care of a group of a third of all documents.
    nodes = written(known.groupBy(F.col("digest").alias("node")).agg(F.min("doc_id").alias("first_id")), "nodes")
    one = known.join(nodes, (F.col("digest") == F.col("node")) & (F.col("doc_id") == F.col("first_id")), "left_semi")
    entries = one.select(F.col("digest").alias("node"), "n", F.explode("bands").alias("band"))
    least = entries.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    shared = written(entries.join(least.select("band", "least"), "band").distinct(), "shared-bands")
    wanted = shared.select("node").distinct().join(nodes, "node").select(F.col("first_id").alias("doc_id")).distinct()
    wanted = written(wanted, "wanted-ids")
    sets = written(full_sets(docs, wanted, k).dropDuplicates(["node"]), "full-sets")
    stars = shared.where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = written(confirmed(stars, sets, percent), "links")
    more = open_links(shared, components(links), sets, percent)
    labels = components(written(links.unionByName(more), "links"))
    linked = nodes.join(labels, "node")
    names = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node = nodes.join(linked.select("node", "component").join(names, "component").select("node", "component_id"), "node", "left")
    of_node = of_node.select(F.col("node").alias("digest"), F.coalesce("component_id", "first_id").alias("component_id"))
    result = sketch.select("doc_id", "n", "digest").join(of_node, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class, that of the smallest id; rows without id stay. Columns as they were.

    A document is an id with its text: of rows that repeat both one stays, and different texts under one id are
    documents of their own, of which a unique one is never lost.
    """
    named, (key, body) = shielded(docs, doc_id, text)
    named = named.withColumn("__document", F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("id"), F.xxhash64(body).alias("text"))))
    groups = near_groups(named, "__document", body, k, percent)
    kept = groups.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__document")).distinct()
    rows = named.where("__document IS NOT NULL").join(kept, "__document", "left_semi").dropDuplicates(["__document"])
    return rows.unionByName(named.where("__document IS NULL")).drop("__document").toDF(*docs.columns)

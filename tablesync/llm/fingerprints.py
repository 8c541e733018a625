"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius by permuted block tables.

Terms of a text are its words and pairs of neighbouring words. Every distinct term votes on 64 bits, for or against by the bits
of its hash, with the number of binary digits of its count as weight; the signs of the sums are the fingerprint. Weights are
whole numbers and sums exact, so every machine finds the same fingerprint. The likeness of two fingerprints is the share of
equal bits.

A search cuts fingerprints into ``blocks`` blocks of bits. Two fingerprints within the radius agree in at least
``blocks - radius`` whole blocks, so one table for each choice of that many blocks, keyed by their bits, finds all of them;
what a table finds is compared in full. Equal fingerprints are one class throughout.

Defined cases: a null text is the empty text; texts without words have the fingerprint 0, and likeness 1 to each other;
rows that repeat an id follow each other in the order of their texts; a row without id comes first; the only document
of a table is its own next one; an empty table gives no rows; a very long text votes a bounded number of terms at a time;
other columns than id and text are not read. Ids are whole numbers, or texts of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import ngram_hashes, word_hashes, words, written

BITS = 64
#: Terms that vote at a time: bounds the memory of very long texts.
CHUNK = 1 << 14


def simhash(text: bytes) -> int:
    """Fingerprint as an unsigned number."""
    hashes = word_hashes(words(text))
    terms, counts = np.unique(np.concatenate([ngram_hashes(hashes, g, s) for s, g in enumerate(((0,), (0, 1)))]), return_counts=True)
    weights, votes = np.frexp(counts)[1].astype(np.float32), np.zeros(BITS)
    for at in range(0, len(terms), CHUNK):
        bits = np.unpackbits(terms[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        some = weights[at : at + CHUNK]
        votes += 2 * (some @ bits.astype(np.float32)) - some.sum()
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def dealt(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (part, lap, id, doc_id, text, own), one partition for each part, sorted; behind the rows of a part is the next one.

    Parts are ranges of the id, equal ids together. The first rows of a part are also sent to the part before, where they
    are not ``own``; those of the first part go to the last one, in lap 1, and close the circle.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = rows.select("id").repartitionByRange(n, "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("id")).collect()
    spread = spark.sparkContext.broadcast(np.array(sorted(r["id"] for r in firsts), np.int64))  # one number for each part

    @F.pandas_udf("array<int>")
    def parts(ids: pd.Series) -> pd.Series:
        bounds, ids = spread.value, ids.to_numpy(np.int64)
        part = np.searchsorted(bounds, ids, side="right") - 1
        first = bounds[part] == ids
        return pd.Series([[p, (p - 1) % len(bounds)] if f else [p] for p, f in zip(part.tolist(), first, strict=True)])

    rows = rows.withColumn("parts", parts("id")).select("doc_id", "id", "text", "parts", F.posexplode("parts").alias("copy", "part"))
    rows = rows.select(
        "part", ((F.col("copy") == 1) & (F.get("parts", F.lit(0)) == 0)).cast("int").alias("lap"), "id", "doc_id", "text",
        (F.col("copy") == 0).alias("own"),
    )
    return rows.repartitionById(max(1, len(firsts)), F.col("part")).sortWithinPartitions("part", "lap", "id", "text")


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited, near_edited, near_next.

    The edited text has its last quarter, in code points, replaced by the beginning of the next document, ascending by id.
    ``fingerprint`` and ``edited`` are 64 bits as a long; the likenesses are to the edited text and to the next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited", "near_edited", "near_next"]
        held = None
        for batch in batches:
            out = []
            for doc, text, part, own in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "part", "own")), strict=True):
                body = (doc, text, simhash(text.encode()), part, own)
                if held and held[4] and held[3] == part:
                    cut = len(held[1]) // 4
                    edited = (held[1][: len(held[1]) - cut] + text[:cut]).encode()
                    mark = simhash(edited)
                    out.append((held[0], len(held[1]), hashlib.sha256(edited).hexdigest(), held[2], mark, likeness(held[2], mark), likeness(held[2], body[2])))
                held = body
            columns = list(zip(*out, strict=True)) or [()] * 7
            marks = [pa.array(np.array(columns[i], np.uint64).view(np.int64)) for i in (3, 4)]
            arrays = [pa.array(columns[0], batch.schema.field("doc_id").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *marks, *(pa.array(columns[i], pa.float64()) for i in (5, 6))], names)

    rows = dealt(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint long, edited long, near_edited double, near_next double"
    )


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def masks(blocks: int, radius: int) -> list[int]:
    """Bits of the key of each table, as signed 64-bit numbers: all choices of ``blocks - radius`` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    found = [sum(chosen) for chosen in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def within_radius(fingerprints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Distinct pairs (query, fingerprint, distance) of fingerprints, both tables with a column ``fingerprint``, within the radius."""
    keys = F.transform(F.array(*(F.lit(m).cast("long") for m in masks(blocks, radius))), lambda m: m.bitwiseAND(F.col("fingerprint")))

    def entries(rows: DataFrame, name: str) -> DataFrame:
        distinct = rows.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
        return distinct.select(F.col("fingerprint").alias(name), F.posexplode(keys).alias("table", "key"))

    pairs = entries(queries, "query").join(entries(fingerprints, "found"), ["table", "key"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    return pairs.select("query", F.col("found").alias("fingerprint"), distance.alias("distance")).where(F.col("distance") <= radius).distinct()

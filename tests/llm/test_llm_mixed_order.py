"""The mix arrives in the sequences: packing follows the order of files and rows."""

from collections import Counter
from math import isqrt

import corpus_pipeline as cp
from tablesync.llm import mixing, packing


def test_sequences_have_the_target_weights(spark, folder, monkeypatch):
    monkeypatch.setattr(cp, "STRETCH_PIECES", 200, raising=False)
    sizes = {"s0": 2000, **{f"s{i}": 80 for i in range(1, 6)}}
    names = [s for s, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, s, "x" * (20 + i * 37 % 900)) for i, s in enumerate(names)], "doc_id long, source string, text string")
    path = folder("mixed")
    # Files of several sizes: Spark reads the large ones first.
    cp.mix_sources(spark, docs, "").write.option("maxRecordsPerFile", 300).parquet(path)
    rows = cp.pack_sequences(spark, spark.read.parquet(path), "").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(names)))
    assert [r["bin_id"] for r in rows] == sorted(r["bin_id"] for r in rows)
    weights = {s: isqrt(n) for s, n in sizes.items()}
    # All sources last for 52 slots of 16 documents. Each end of a stretch is less than a block from the weights.
    for at in range(0, 800, 200):
        found = Counter(names[r["doc_id"]] for r in rows[at : at + 200])
        assert all(abs(found[s] - 200 * w / sum(weights.values())) < 32 for s, w in weights.items())


def test_stretches_are_consecutive(spark, folder):
    docs = spark.createDataFrame([(i, "x" * (i * 31 % 700)) for i in range(1000)], "doc_id long, text string")
    path = folder("docs")
    docs.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", 170).parquet(path)
    for given in (spark.read.parquet(path), docs.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")):
        rows = packing.pack_documents(given, lengths=(64, 256), group_pieces=150).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r["bin_id"] // packing.BINS, []).append((r["doc_id"], r["piece"]))
        order = [sorted(groups[g]) for g in sorted(groups)]
        want = sorted((i, p) for i in range(1000) for p in range((i * 31 % 700) // 256 + 1))
        assert [x for g in order for x in g] == want and max(map(len, order)) <= 150


def test_mixed_files_keep_their_order_in_bins(spark, folder):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "x" * 90) for i in range(600)], "doc_id long, source string, text string")
    path = folder("mixed")
    cp.mix_sources(spark, docs, "").write.option("maxRecordsPerFile", 70).parquet(path)
    want = [r["doc_id"] for r in mixing.mix(docs).orderBy("slot", "pos").collect()]
    rows = packing.pack_documents(spark.read.parquet(path), lengths=(91,), group_pieces=100).collect()
    assert [r["doc_id"] for r in rows] == want

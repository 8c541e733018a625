"""Registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.llm import (
    ann,
    fingerprints,
    hard_negatives,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    secrets,
    token_counts,
    token_output,
    toxicity,
    whitening,
)
from tablesync.llm.common import table, written

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

#: Share of a triangle inequality that prunes; see README for the recall that it gives.
ANN_FACTOR = 0.2
END_ID = 2


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


@query
def op1_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op2_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "pos")


@query
def op3_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op4_token_output(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = token_output.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_output.crc_of_ids(found)


@query
def op5_near_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return near_dedup.near_groups(docs, k=3, percent=85)


@query
def op6_secrets(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return secrets.report(secrets.scan(docs))


@query
def op7_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op8_ann(spark, sf):
    vectors = ann.usable(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return ann.search(ann.build(vectors), vectors.where("vec_id % 20 = 0"), k=20, factor=ANN_FACTOR)


@query
def op9_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_tokens", "token_score")


@query
def op10_fingerprints(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = written(fingerprints.fingerprint_documents(docs), "fingerprints")
    # Every hundredth id asks how many documents have a fingerprint within the radius, its own included.
    asked = rows.where("doc_id % 100 = 0").select("fingerprint")
    classes = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    pairs = fingerprints.within_radius(classes, asked).join(classes, "fingerprint")
    within = pairs.groupBy(F.col("query").alias("fingerprint")).agg(F.sum("n").alias("n_found"))
    # By id and fingerprint: rows that repeat an id may have different texts, and must not multiply.
    asking = rows.where("doc_id % 100 = 0").select("doc_id", "fingerprint").distinct().join(within, "fingerprint")
    return rows.join(asking, ["doc_id", "fingerprint"], "left").select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.hexadecimal(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.hexadecimal(F.col("edited")).alias("edited_fingerprint"), "near_edited", "near_next",
        F.col("n_found").alias("n_within_radius"),
    )


@query
def op11_licenses(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return licenses.report(*licenses.scan(docs))


@query
def op12_whitening(spark, sf):
    return whitening.whitened_embeddings(table(spark, sf, "embeddings"))


@query
def op13_hard_negatives(spark, sf):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable(table(spark, sf, "embeddings"), moved)
    return hard_negatives.mine(rows, rows.where("vec_id % 100 = 0"))

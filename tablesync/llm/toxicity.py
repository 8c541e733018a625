"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features of a text are the distinct buckets of its words, word pairs and pairs over one word, without case and
punctuation. FTRL-proximal keeps a learning rate for every coordinate and an L1 penalty, so the weights that remain are few:
sorted pairs (bucket, weight) that go to all tasks. A text's score is the logistic of the sum over its features.

Training reads a bounded sample of labelled rows (``sample_rows``, those with the smallest hash of the id, so the same rows
in any layout of the input), as an online learner does: one task, one pass of ``epochs``. Scoring reads every whole text.

Defined cases: a null or empty text has the bias alone; labels that repeat an id count as toxic if any of them is 1; null
labels and labels without a document are left out; without any label every score is close to 0, as nothing speaks for 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import ngram_hashes, restored, shielded, word_hashes, written

#: Bits of a feature bucket.
BITS = 22
#: Offsets of the words of a feature: words, pairs, pairs over one word.
GRAMS = ((0,), (0, 1), (0, 2))
WORD = re.compile(r"[^\W_]+")
#: Bias of a model that saw no label.
UNTRAINED = -20.0


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the training rows; the others are the usual parameters of FTRL-proximal, chosen on fold 4."""

    sample_rows: int = 12_000
    epochs: int = 5
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 1.0


@dataclass(frozen=True)
class Model:
    """Sorted buckets with a weight other than 0, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.buckets] = self.weights
        sums = np.empty(len(texts))
        for i, text in enumerate(texts):
            found = features(text)
            hit = np.unique(found[dense[found] != 0])
            sums[i] = self.bias + dense[hit].sum(dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def features(text: str) -> np.ndarray:
    """Buckets of all features, repeated as they occur."""
    hashes = word_hashes(WORD.findall(text.lower()))
    found = [ngram_hashes(hashes, gram, seed) for seed, gram in enumerate(GRAMS)]
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal over buckets; the last place is the bias, without a penalty."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, s = self.z[at], self.s
        l1 = np.where(at == 1 << BITS, 0, s.l1)
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, text: str, label: int) -> None:
        at = np.append(np.unique(features(text)), 1 << BITS)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + gradient * gradient

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.abs(self.z) > 0)
        w = self.weights(at)
        return at[w != 0], w[w != 0]


def fold(doc_id: Column) -> Column:
    """Fold 0 to 4 of a document; fold 0 is held out. A null id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, settings: Settings) -> DataFrame:
    """(order, text, label) of the sample: labelled documents outside of the held-out fold."""
    marked = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic"))
    marked = marked.where((fold(F.col("__id")) != 0) & F.col("__toxic").isin(0, 1))
    marked = marked.groupBy("__id").agg(F.max("__toxic").alias("label"))
    ids = docs.select(F.col(doc_id).alias("__id")).join(marked, "__id", "left_semi").distinct()
    chosen = ids.orderBy(F.xxhash64("__id"), "__id").limit(settings.sample_rows)
    # At most sample_rows ids and labels: a bounded broadcast.
    chosen = written(marked.join(F.broadcast(chosen), "__id", "left_semi"), "toxicity-sample")
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "__id").groupBy("__id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model:
    """Train on the labels of the folds 1 to 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen = Ftrl(settings), 0
        for batch in batches:
            for row, label in zip(batch["text"], batch["label"].to_pylist(), strict=True):
                learner.learn(row.as_py(), label)
                seen += 1
        if seen:
            at, weights = learner.kept()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(weights, pa.float64())], ["bucket", "weight"])

    rows = training_rows(docs, labels, doc_id, text, settings)
    rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.lit(settings.epochs))))
    rows = rows.repartition(1).sortWithinPartitions("__epoch", F.xxhash64("__id", "__epoch"), "__id").select("text", "label")
    found = rows.mapInArrow(run, "bucket long, weight double").toPandas().sort_values("bucket")
    buckets, weights = found["bucket"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)
    bias = weights[buckets == 1 << BITS]
    return Model(buckets[buckets < 1 << BITS], weights[buckets < 1 << BITS], float(bias[0]) if len(bias) else UNTRAINED)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Documents with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); columns of these names are replaced."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS pairs

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(spread.value.scores(batch.tolist()))

    named, (body,) = shielded(docs, text)
    rows = named.withColumn("score", scores(F.coalesce(body, F.lit(""))))
    return restored(rows, docs.columns, {"score": F.col("score"), "predicted": (F.col("score") >= 0.5).cast("int")})


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are predicted to be clean, with the columns they had."""
    named, (key, body) = shielded(docs, doc_id, text)
    model = fit(named, labels, key, body)
    return score(named, model, body).where("predicted = 0").drop("score", "predicted").toDF(*docs.columns)

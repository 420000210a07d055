"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

A document's features are the hashes of its words, its pairs of neighbouring words, and
its pairs with one or two words between, each counted once.  FTRL-proximal keeps two
numbers for each coordinate, which give it a learning rate of its own, and its L1 term
leaves weights at zero until there is evidence; the few others are the broadcast model
(at most ``DIMS`` numbers, whatever the corpus).  Learning reads at most ``max_train``
labelled documents (those of smallest id hash); scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, prepare, text_slices, written
from tessera.llm.lsa_decontam import _lowered, terms

DIMS = 1 << 20
GAPS = (1, 2, 3)  # neighbours, and skips of one and two words
MAX_TRAIN = 16_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 1.0


def grams(row: np.ndarray, h: np.ndarray):
    """(text, feature) of all n-grams and skip-grams, with repeats."""
    rows, out = [row], [h]
    for gap in GAPS:
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            out.append(mix(h[:-gap][same] + np.uint64(gap)) ^ h[gap:][same])
    return np.concatenate(rows), (mix(np.concatenate(out)) >> np.uint64(44)).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss over binary features; the last coordinate is the bias."""

    def __init__(self, dims: int = DIMS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(dims + 1), np.zeros(dims + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0,
                        -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, features: np.ndarray, label: float) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _feature_rows(batches):
    for batch in batches:
        for sub, data, off in text_slices(_lowered(batch)):
            _, _, row, h = terms(data, off)
            row, feature = grams(row, h)
            key = np.unique(row * DIMS + feature)
            at = np.searchsorted(key, np.arange(len(off)) * DIMS)
            packed = [(key[a:b] % DIMS).astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([sub.column(1), sub.column(2), pa.array(packed, pa.binary())], ["label", "turn", "features"])


def _train(frames):
    rows = [(t, f, y) for b in frames for t, f, y in zip(b["turn"], b["features"], b["label"], strict=True)]
    rows.sort()  # a fixed order, however the rows came
    model = Ftrl()
    for _ in range(EPOCHS):
        for _, f, y in rows:
            model.learn(np.frombuffer(f, np.int32), float(y))
    w = model.weights()
    at = np.flatnonzero(w)
    yield pd.DataFrame({"feature": at, "weight": w[at]})


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights (``DIMS`` and the bias) learned from ``labels`` (doc_id, toxic), null labels left out.
    Of several labels of a document the largest counts.  Without labels all weights are zero."""
    prepare(docs.sparkSession)
    labels = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id"))
              .agg(F.max("toxic").cast("int").alias("label")))
    chosen = written(labels.withColumn("turn", F.xxhash64("_id")).orderBy("turn", "_id").limit(max_train))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = (docs.join(F.broadcast(chosen), docs.doc_id == chosen._id)  # at most max_train short rows
            .select("text", "label", "turn").mapInArrow(_feature_rows, "label int, turn bigint, features binary"))
    learned = rows.repartition(1).mapInPandas(_train, "feature bigint, weight double").toPandas()
    w = np.zeros(DIMS + 1)
    w[learned["feature"].to_numpy(np.int64)] = learned["weight"].to_numpy()
    return w


def _score_rows(weights):
    def run(batches):
        w = weights.value
        for batch in batches:
            for sub, data, off in text_slices(_lowered(batch)):
                _, _, row, h = terms(data, off)
                row, feature = grams(row, h)
                live = w[feature] != 0
                key = np.unique(row[live] * DIMS + feature[live])
                z = np.bincount(key // DIMS, weights=w[key % DIMS], minlength=len(off) - 1) + w[DIMS]
                yield pa.RecordBatch.from_arrays([sub.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], ["doc_id", "score"])
    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every document row; the score depends on the text alone.  A null text counts as
    empty: its score is the bias'.  Repeated rows and null ids are scored like others; other columns are
    ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(weights)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_score_rows(sent), "doc_id bigint, score double")


def held_out(doc_id: str) -> Column:
    """Whether a document's label must not be learned from: crc32 of its id as text is 2 modulo 4 (null: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, toxic_from: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labels that are not held out, scored everywhere."""
    weights = train(docs, labels.where(~held_out("doc_id")), max_train)
    return score(docs, weights).select("doc_id", held_out("doc_id").alias("held_out"), "score",
                                       (F.col("score") >= toxic_from).cast("int").alias("predicted"))

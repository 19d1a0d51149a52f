"""Quality scores: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates.

Training reads a bounded sample of labelled documents. The sample is split into a few
parts, each part makes passes of per-coordinate updates in a task of its own, and the
weights of the parts are averaged. The model is one vector of fixed length; a score is
the dot product of a document's sparse features with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.llm.shingles import HASHES, mixed
from ridelens.llm.tables import held_out, table

#: Hashed features: the length of the model is two to this power.
BITS = 18
#: Most labelled documents that training reads, drawn by a hash of their id.
MOST_LABELLED = 12_000
#: Parts of the sample that are trained side by side.
PARTS = 2
EPOCHS = 3
#: Largest distance of two equal words that counts as a repetition.
AGAIN = 4
THRESHOLD = 0.7
# Step size, its smoothing, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.001
SEED = "quality-1"
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text: its words, marks, pairs of neighbours and pairs of
    equal words close by, hashed; damped counts scaled to length 1. A text without any has none."""
    tokens = _TOKEN.findall((text or "").lower())
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    one = np.fromiter(map(HASHES.__getitem__, tokens), np.uint64, len(tokens))
    two = mixed(mixed(one[:-1]) * np.uint64(3) + one[1:])
    # Pairs at a short distance that say the same twice share one feature per distance.
    again = [
        np.full(int((one[d:] == one[:-d]).sum()), d, np.uint64) for d in range(1, AGAIN + 1)
    ]
    index = (mixed(np.concatenate([one, two, *again])) >> np.uint64(64 - BITS)).astype(np.int64)
    index, counts = np.unique(index, return_counts=True)
    values = np.sqrt(counts)
    return index, values / np.sqrt(counts.sum())


class FollowTheLeader:
    """Per-coordinate updates with lazy weights; an intercept is the last coordinate."""

    def __init__(self, size: int = 1 << BITS):
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def weights_at(self, index: np.ndarray) -> np.ndarray:
        z = self.z[index]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(self.n[index])) / ALPHA + L2)

    def update(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights_at(index)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        before = self.n[index]
        after = before + g * g
        self.z[index] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
        self.n[index] = after

    def weights(self) -> np.ndarray:
        return self.weights_at(np.arange(len(self.z))).astype(np.float32)


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after passes over the documents in the order given; the intercept is last."""
    model, size = FollowTheLeader(), 1 << BITS
    rows = []
    for text in texts:
        index, values = features(text)
        rows.append((np.append(index, size), np.append(values, 1.0)))
    for _ in range(epochs):
        for (index, values), label in zip(rows, labels, strict=True):
            model.update(index, values, label)
    return model.weights()


def score(text: str | None, weights: np.ndarray) -> float:
    index, values = features(text)
    return float(1 / (1 + np.exp(-np.clip(weights[index] @ values + weights[-1], -35, 35))))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    most_labelled: int = MOST_LABELLED,
    parts: int = PARTS,
) -> np.ndarray:
    """The model's weights, from documents whose id is not held out.

    Labels other than 0 and 1, and labels or documents without an id, are left out; of
    several labels of one id all are used. Without any label every weight is 0, and so
    every score a half. ``most_labelled`` bounds the sample; ids are drawn by hash.
    """
    order = F.xxhash64(F.lit(SEED), F.col("_id"))
    drawn = (
        labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_label"))
        .filter(F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
        .orderBy(order, "_id", "_label")
        .limit(most_labelled)
        .withColumn("_part", F.pmod(order, F.lit(parts)).cast("int"))
    )
    texts = docs.select(docs[id_col].alias("_doc"), docs[text_col].cast("string").alias("_text"))
    # At most `most_labelled` ids.
    sample = texts.join(F.broadcast(drawn), F.col("_doc") == F.col("_id"))
    sample = sample.withColumn("_order", F.xxhash64(F.lit(SEED), F.lit("order"), F.col("_id")))

    def of_part(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "_label"])
        weights = fit(part["_text"].tolist(), part["_label"].tolist())
        return pd.DataFrame({"rows": [len(part)], "weights": [weights.tobytes()]})

    models = (
        sample.select("_part", "_text", "_label", "_order")
        .groupBy("_part")
        .applyInPandas(of_part, "rows long, weights binary")
        .collect()  # `parts` vectors of fixed length
    )
    total = sum(m.rows for m in models)
    out = np.zeros((1 << BITS) + 1, np.float32)
    for m in sorted(models, key=lambda m: (m.rows, bytes(m.weights))):
        out += np.frombuffer(m.weights, np.float32) * np.float32(m.rows / total)
    return out


def score_documents(
    docs: DataFrame,
    weights: np.ndarray,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row and whole text.

    Empty and null texts get the score of the intercept. The id may be null (held out)
    or repeated; other columns are not read. Empty in, empty out.
    """
    fields = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(t.as_py(), weights) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64())],
                names=fields.names,
            )

    slim = docs.select(
        docs[id_col].alias("id"),
        held_out(docs[id_col]).alias("held_out"),
        docs[text_col].cast("string").alias("text"),
    )
    predicted = (F.col("score") >= threshold).cast("int")
    return slim.mapInArrow(scored, fields).withColumn("predicted", predicted)


def accepted(docs: DataFrame, weights: np.ndarray, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([score(t.as_py(), weights) for t in texts], pa.float64())

    return docs.filter(scores(docs["text"].cast("string")) >= threshold)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))

"""Bounded samples of labelled documents, and scores made into probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, seed: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(id, text, label, fit) of about `size` labelled rows per class, and how many rows each class has.

    Rows are chosen by a hash of the id, so their number is bounded and they can be broadcast; `fit` holds for three quarters of them, the rest calibrates.
    Rows with a null label or id are left out. An id that several labels contradict is taken with each.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")).where("_id is not null and label is not null")
    counts = {r["label"]: r["count"] for r in rows.where("label in (0, 1)").groupBy("label").count().collect()}
    part = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for value, count in counts.items():
        chosen = chosen | ((F.col("label") == value) & (part < size / count))
    rows = rows.where(chosen).dropDuplicates()
    fit = F.pmod(F.xxhash64(F.lit(seed + " fit"), "_id"), F.lit(4)) > 0
    rows = rows.withColumn("fit", fit)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(rows), F.col("id") == F.col("_id")).select("id", "text", "label", "fit"), counts


class Calibration:
    """Monotone map from a raw score to the chance of label 1, by pooling adjacent violators."""

    def __init__(self, raw: np.ndarray, label: np.ndarray, weight: np.ndarray):
        order = np.argsort(raw, kind="stable")
        means, weights, places = [], [], []
        for x, y, w in zip(raw[order], label[order].astype(float), weight[order]):
            means.append(y)
            weights.append(w)
            places.append((x, x))
            while len(means) > 1 and means[-2] >= means[-1]:
                y, w, (_, high) = means.pop(), weights.pop(), places.pop()
                total = weights[-1] + w
                means[-1] = (means[-1] * weights[-1] + y * w) / total
                weights[-1] = total
                places[-1] = (places[-1][0], high)
        # Towards the overall share by one pooled row, so that no block claims certainty.
        share = float((label * weight).sum() / weight.sum()) if len(label) else 0.5
        one = float(np.median(weight)) if len(label) else 1.0
        self.at = np.array([p for low, high in places for p in (low, high)] or [0.0])
        self.chance = np.array([c for m, w in zip(means, weights) for c in 2 * [(m * w + share * one) / (w + one)]] or [share])
        self.chance = np.maximum.accumulate(self.chance)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.chance)


def class_weights(label: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give a sample the class shares of all labelled rows."""
    return np.array([counts.get(int(y), 1) / max(1, int((label == y).sum())) for y in label])

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.labelled import Calibration, class_weights, labelled_sample
from panelmill.llm.scan import Scanner, mixed

#: Labelled rows of a class in the sample, about.
SAMPLE = 2500
#: Bits of a feature; words between the two of a skip-gram.
BITS, SKIPS = 20, (0, 1, 2)
#: Learning rate, its smoothing, L1 and L2; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 6.0, 1.0, 5
ROWS = 200


def scanner() -> Scanner:
    """Words are runs of ASCII letters and digits and of all other characters beyond ASCII."""
    made = Scanner(seed=7, lower=True)
    made.space[:128] = [not chr(c).isalnum() for c in range(128)]
    return made


def features(made: Scanner, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and features of all words, neighbouring pairs and pairs with words between."""
    words = made.words(column)
    h = words.hashes
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    rows, found = [owner], [h]
    for skip in SKIPS:
        gap = skip + 1
        same = owner[:-gap] == owner[gap:]
        pair = mixed(h[:-gap] * np.uint64(2 * gap + 1) + h[gap:] + np.uint64(gap))
        rows.append(owner[:-gap][same])
        found.append(pair[same])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """The features with weight, their weights, and the calibration."""

    used: np.ndarray
    weights: np.ndarray
    offset: float
    calibration: Calibration


class Ftrl:
    """Weights follow from sums of gradients and squared gradients of their own coordinate."""

    def __init__(self, size: int):
        self.z, self.n, self.size = np.zeros(size), np.zeros(size), size

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, weights: np.ndarray, gradient: float) -> None:
        n = self.n[at]
        rate = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA
        self.z[at] += gradient - rate * weights
        self.n[at] = n + gradient * gradient


def train(rows: list[np.ndarray], label: np.ndarray, fit: np.ndarray, counts: dict[int, int], seed: int = 5) -> Model:
    draw = np.random.Generator(np.random.PCG64(seed))
    learner, offset, squares = Ftrl(1 << BITS), 0.0, 1.0
    chosen = np.flatnonzero(fit)
    for _ in range(PASSES):
        for i in draw.permutation(chosen):
            w = learner.weights(rows[i])
            g = 1 / (1 + np.exp(-np.clip(w.sum() + offset, -30, 30))) - label[i]
            learner.learn(rows[i], w, g)
            squares += g * g
            offset -= 0.1 * g / np.sqrt(squares)
    weights = learner.weights(slice(None))
    used = np.flatnonzero(weights)
    check = np.flatnonzero(~fit) if (~fit).any() else np.arange(len(rows))
    raw = np.array([weights[rows[i]].sum() + offset for i in check])
    calibration = Calibration(raw, label[check], class_weights(label[check], counts))
    return Model(used, weights[used].astype(np.float32), float(offset), calibration)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: id, text, label, fit to id, label, fit and the text's distinct features."""
    made = scanner()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            owner, found = features(made, part.column(1))
            both = np.unique((owner << BITS) + found)
            cuts = np.searchsorted(both >> BITS, np.arange(part.num_rows + 1))
            found = (both & ((1 << BITS) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(2), part.column(3),
                pa.array([found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            ], names=["id", "label", "fit", "features"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from about SAMPLE labelled rows of each class; their distinct features reach the driver."""
    rows, counts = labelled_sample(docs, labels, label, SAMPLE, "toxicity", id_col, text_col)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType()),
        T.StructField("fit", T.BooleanType()), T.StructField("features", T.BinaryType()),
    ])
    found = rows.mapInArrow(_distinct, schema).toPandas().sort_values(["label", "id"], kind="stable")
    lists = [np.frombuffer(f, np.uint32) for f in found["features"]]
    return train(lists, found["label"].to_numpy(int), found["fit"].to_numpy(bool), counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and score (0 to 1) of every row by its whole text; each distinct feature counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = scanner()
        table = np.zeros(1 << BITS, np.float32)
        table[model.used] = model.weights
        for batch in batches:
            raw = np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                owner, found = features(made, part.column(1))
                hit = table[found] != 0
                both = np.unique((owner[hit] << BITS) + found[hit])
                raw[at:at + part.num_rows] = np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], part.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.calibration(raw + model.offset), pa.float64())], names=["id", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)

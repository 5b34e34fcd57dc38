"""Quality by compression with dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.labelled import Calibration, class_weights, labelled_sample
from panelmill.llm.scan import flat

#: Labelled rows of a class in the sample, about; bytes of a dictionary; compression level.
SAMPLE, DICTIONARY, LEVEL = 1500, 112 * 1024, 3
#: Bytes of one training sample, and how many are taken of a document for a dictionary, spread evenly
#: over its text. This bounds what is fitted on; scores compress whole texts.
PART, PARTS = 1024, 8


@dataclass
class Model:
    good: bytes
    bad: bytes
    calibration: Calibration


def _dictionary(texts: list[bytes]) -> bytes:
    parts = []
    for t in texts:
        starts = range(0, max(1, len(t) - PART // 4), PART)
        step = max(1, -(-len(starts) // PARTS))
        parts += [t[a:a + PART] for a in starts[::step] if t]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(parts)[-DICTIONARY:]


class Compressor:
    """Sizes of texts compressed with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        def make(d: bytes):
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )

        self.good, self.bad = make(good), make(bad)

    def difference(self, text: bytes) -> float:
        """How many bytes per byte of text the good dictionary saves over the bad one."""
        if not text:
            return 0.0
        return (len(self.bad.compress(text)) - len(self.good.compress(text))) / len(text)


def train(texts: list[bytes], label: np.ndarray, fit: np.ndarray, counts: dict[int, int]) -> Model:
    good, bad = (_dictionary([t for t, y, f in zip(texts, label, fit) if f and y == want]) for want in (1, 0))
    check = np.flatnonzero(~fit) if (~fit).any() else np.arange(len(texts))
    compressor = Compressor(good, bad)
    raw = np.array([compressor.difference(texts[i]) for i in check])
    return Model(good, bad, Calibration(raw, label[check], class_weights(label[check], counts)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: id, text, label, fit with evenly spread parts of each text, joined, as its text."""
    for batch in batches:
        data, rows = flat(batch.column(1))
        out = []
        for a, b in zip(rows[:-1], rows[1:]):
            starts = range(a, b, PART)
            step = max(1, -(-len(starts) // PARTS))
            out.append(b"".join(data[s:min(s + PART, b)].tobytes() for s in starts[::step]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2), batch.column(3)], names=["id", "text", "label", "fit"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Dictionaries and calibration from a bounded sample of labelled rows; PARTS * PART bytes of each."""
    rows, counts = labelled_sample(docs, labels, label, SAMPLE, "quality", id_col, text_col)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("text", T.BinaryType()),
        T.StructField("label", T.IntegerType()), T.StructField("fit", T.BooleanType()),
    ])
    found = rows.mapInArrow(_parts, schema).toPandas().sort_values(["label", "id"], kind="stable")
    texts = [bytes(t) for t in found["text"]]
    return train(texts, found["label"].to_numpy(int), found["fit"].to_numpy(bool), counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and score (0 to 1) of every row by its whole text; null and empty texts have a difference of 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = Compressor(model.good, model.bad)
        for batch in batches:
            data, rows = flat(batch.column(1))
            raw = np.array([compressor.difference(data[a:b].tobytes()) for a, b in zip(rows[:-1], rows[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.calibration(raw), pa.float64())], names=["id", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)

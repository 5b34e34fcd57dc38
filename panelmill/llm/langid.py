"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.scan import flat, slices

#: Rows per language that a model is fitted on, and as many that it is calibrated on, about.
SAMPLE = 300
BUCKETS, WIDTH, BATCH = 1 << 15, 12, 16
#: Passes over the rows, but as many steps at least; learning rates of embeddings and output.
EPOCHS, STEPS, RATE, OUTPUT_RATE = 4, 1500, 40.0, 0.5
GRAMS = (2, 3, 4)
#: Share of calibration rows that rejection may cost, and the score above which nothing is rejected.
REJECTED, SURE = 0.001, 0.5
#: Bytes of text scanned at once, and bytes of the rows that are scored and filtered at once.
PIECE, SLICE = 1 << 17, 1 << 18
UNKNOWN = "und"


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and capitals of Latin-1 in lower case, and blanks for all ASCII but letters."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 0x20
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    out = fold[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[capital] += 0x20
    return out


def _buckets(text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and buckets of the subwords of `size` bytes that do not start in a run of blanks."""
    n = len(text) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.full(n, size, np.uint64)
    for i in range(size):
        key = (key << np.uint64(8)) | text[i:i + n]
    at = np.flatnonzero((text[:n] != 0x20) | (text[1:n + 1] != 0x20))
    h = key[at] * np.uint64(0x9E3779B97F4A7C15)
    return at, (h >> np.uint64(64 - 15)).astype(np.int64)


def subwords(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, buckets, number of rows) of the subwords of whole texts, in pieces of bounded size."""
    data, rows = flat(column)
    for a in range(0, len(data), PIECE):
        text = _letters(data[a:a + PIECE + max(GRAMS) - 1])
        for size in GRAMS:
            at, bucket = _buckets(text, size)
            at = at[at < PIECE]
            bucket = bucket[:len(at)]
            owner = np.searchsorted(rows, a + at, "right") - 1
            same = a + at + size <= rows[owner + 1]
            yield owner[same], bucket[same]


def _has_letter(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows with a letter of any script."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    full = rows[1:] > rows[:-1]
    found = np.zeros(len(full), bool)
    found[full] = np.logical_or.reduceat(ascii_letter[data], rows[:-1][full])
    for i in np.flatnonzero(~found & full):
        found[i] = any(c.isalpha() for c in data[rows[i]:rows[i + 1]].tobytes().decode(errors="replace"))
    return found


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: id, text, label, part to id, label, part and the counts of the text's buckets."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            counts = np.zeros((part.num_rows, BUCKETS), np.float32)
            for owner, bucket in subwords(part.column(1)):
                counts += np.bincount(owner * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
            ids, shares = [], []
            for row in counts:
                used = np.flatnonzero(row)
                ids.append(used.astype(np.uint16).tobytes())
                shares.append((row[used] / max(1.0, row.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())],
                names=["id", "label", "fit", "buckets", "shares"],
            )


@dataclass
class Model:
    """Weights of each bucket (embedding times output), offsets, temperature and rejection score."""

    languages: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    temperature: float
    reject: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _means(docs: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray) -> np.ndarray:
    return np.stack([shares @ table[used] if len(used) else np.zeros(table.shape[1]) for used, shares in docs])


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, fit: np.ndarray, languages: list[str], seed: int = 3) -> Model:
    """Fits embeddings and softmax by stochastic gradient descent; temperature and rejection on the rest."""
    draw = np.random.Generator(np.random.PCG64(seed))
    k = len(languages)
    table = draw.normal(0, 1, (BUCKETS, WIDTH))
    out, offset = np.zeros((WIDTH, k)), np.zeros(k)
    chosen = np.flatnonzero(fit)
    per_pass = max(1, -(-len(chosen) // BATCH))
    passes = max(EPOCHS, -(-STEPS // per_pass)) if k > 1 else 0
    step, steps = 0, passes * per_pass
    for _ in range(passes):
        order = draw.permutation(chosen)
        for a in range(0, len(order), BATCH):
            some = order[a:a + BATCH]
            slower = 1 - step / (steps + 1)
            step += 1
            hidden = _means([docs[i] for i in some], table)
            error = _softmax(hidden @ out + offset)
            error[np.arange(len(some)), labels[some]] -= 1
            error /= len(some)
            back = error @ out.T
            out -= OUTPUT_RATE * slower * hidden.T @ error
            offset -= OUTPUT_RATE * slower * error.sum(axis=0)
            for i, g in zip(some, back):
                used, shares = docs[i]
                table[used] -= RATE * slower * shares[:, None] * g
    weights = table @ out
    check = np.flatnonzero(~fit) if (~fit).any() else chosen
    temperature, reject = 1.0, 0.0
    if len(check):
        raw = _means([docs[i] for i in check], weights) + offset
        grid = np.geomspace(0.5, 20, 60)
        loss = [-np.log(_softmax(raw / t)[np.arange(len(check)), labels[check]] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        reject = min(SURE, float(np.quantile(_softmax(raw / temperature).max(axis=1), REJECTED)))
    return Model(languages, weights.astype(np.float32), offset, temperature, reject)


def sample(docs: DataFrame, label: str, seed: str, size: int, id_col: str = "doc_id") -> DataFrame:
    """About `size` rows per label, chosen by a hash of the id, so that `size` bounds what is fitted on.

    One count per label reaches the driver.
    """
    counts = {r["label"]: r["count"] for r in docs.groupBy(F.col(label).alias("label")).count().collect()}
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    chosen: Column = F.lit(False)
    for value, count in counts.items():
        chosen = chosen | ((F.col(label) == F.lit(value)) & (part < size / count))
    return docs.where(chosen)


def _views(found: pa.Table, order: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and shares of the rows in this order, as views of the Arrow buffers."""
    out = []
    for i in order:
        used, shares = found["buckets"][i].as_buffer(), found["shares"][i].as_buffer()
        out.append((np.frombuffer(used, np.uint16), np.frombuffer(shares, np.float32)) if used.size else (np.zeros(0, np.uint16), np.zeros(0, np.float32)))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages in `docs`, from about SAMPLE rows of each, three quarters to fit.

    Rows without language are left out. Their bucket counts, not their texts, reach the driver, once, and
    are given back after the fit. With no rows at all, the model knows no language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("label"))
    rows = sample(rows.where("label is not null"), "label", "langid", 2 * SAMPLE, "id")
    part = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(2)) == 0
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", docs.schema[lang_col].dataType),
        T.StructField("fit", T.BooleanType()), T.StructField("buckets", T.BinaryType()), T.StructField("shares", T.BinaryType()),
    ])
    found = rows.select("id", "text", "label", part.alias("fit")).mapInArrow(_features, schema).toArrow()
    order = pa.compute.sort_indices(found.select(["label", "id"]), [("label", "ascending"), ("id", "ascending")]).to_pylist()
    names = found["label"].to_pylist()
    languages = sorted(set(names))
    number = {name: i for i, name in enumerate(languages)}
    labels = np.array([number[names[i]] for i in order], np.int64)
    chosen = np.array(found["fit"].to_pylist(), bool)[order]
    model = train(_views(found, order), labels, chosen, languages)
    del found
    pa.default_memory_pool().release_unused()
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            data, rows = flat(batch.column(1))
            n, k = batch.num_rows, len(model.languages)
            sums, total = np.zeros((n, k)), np.zeros(n)
            for owner, bucket in subwords(batch.column(1)):
                if len(owner) and k:
                    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    sums[owner[starts]] += np.add.reduceat(model.weights[bucket], starts, axis=0)
                    total[owner[starts]] += np.diff(np.append(starts, len(owner)))
            known = _has_letter(data, rows) if len(data) else np.zeros(n, bool)
            best, score = np.full(n, k), np.zeros(n)
            if k:
                chance = _softmax((sums / np.maximum(total, 1)[:, None] + model.offsets) / model.temperature)
                best = np.where(known, chance.argmax(axis=1), k)
                score = np.where(known, chance.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i) for i in range(batch.num_columns) if i != 1], pa.array(names[best], pa.string()),
                pa.array(score, pa.float64()), pa.array((best == k) | (score < model.reject), pa.bool_()),
            ], names=[*[batch.schema.names[i] for i in range(batch.num_columns) if i != 1], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred, score and rejected for every row of `docs`, by its whole text alone.

    A text that is null or has no letter is `und` with score 0. Rejected are those and texts whose
    best language scores below the model's calibrated rejection score.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
    ])
    return texts.mapInArrow(_scored(model), schema)


def only_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `identify` rejects, in one pass over the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scored(model)
        at = names.index(text_col)
        for batch in (part for whole in batches for part in slices(whole, at, SLICE)):
            text = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], names=["none", "text"])
            rejected = pa.concat_arrays([verdict.column(verdict.num_columns - 1) for verdict in score(iter([text]))])
            yield batch.filter(pa.compute.invert(rejected))

    names = docs.columns
    return docs.mapInArrow(run, docs.schema)

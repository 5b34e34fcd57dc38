"""Repeated word sequences within and between documents, found at difference-cover anchors."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.scan import Scanner, Words, flat
from panelmill.session import materialise, release

#: Words of a window that counts as repeated.
WINDOW = 35
#: A difference cover. Every residue modulo PERIOD is a difference of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Words hashed at an anchor. Of the PERIOD first offsets of a match one is a cover position on both
#: sides, and ANCHOR words from there still lie within the match.
ANCHOR = WINDOW - PERIOD + 1
ROWS = 500
#: Windows that a task combines before they leave it; also those of a hash bucket, about.
BUFFER = 500_000
HASH = np.dtype([("high", "<i8"), ("low", "<i4")])


def _anchors(scanner: Scanner, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word places and hashes of the anchors of each row; places count from the row's own start."""
    on_cover = np.zeros(PERIOD, bool)
    on_cover[list(COVER)] = True
    place = np.arange(len(words.hashes)) - np.repeat(words.offsets[:-1], words.counts)
    at = scanner.room(words, ANCHOR)
    at = at[on_cover[place[at] % PERIOD]]
    return at, scanner.windows(words, at, ANCHOR).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: id and text to (id, anchors): the hashes of a text's anchors."""
    scanner = Scanner(seed=6)
    for part in _parts(batches):
        words = scanner.words(part.column(1))
        at, hashes = _anchors(scanner, words)
        ends = np.searchsorted(at, words.offsets).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes)),
        ], names=["id", "anchors"])


def _spans(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of one row: its row, first and last start. Sorted by both."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[:len(first)] - 1
    return row[first], start[first], start[last]


def _near_anchors(one: Scanner, two: Scanner, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, start and both hashes of the windows whose first PERIOD offsets hold a repeated anchor."""
    words = one.words(part.column(1))
    again = two.words(part.column(1))
    at, hashes = _anchors(one, words)
    repeated, rows = part.column(2).values.to_numpy(), part.column(2).offsets.to_numpy()
    ends = np.searchsorted(at, words.offsets)
    marks = np.zeros(len(words.hashes) + 1, np.int64)
    for i in range(part.num_rows):
        own = slice(ends[i], ends[i + 1])
        hit = at[own][np.isin(hashes[own], repeated[rows[i]:rows[i + 1]])]
        np.add.at(marks, np.maximum(hit - PERIOD + 1, words.offsets[i]), 1)
        np.add.at(marks, hit + 1, -1)
    near = np.cumsum(marks)[:-1] > 0
    starts = one.room(words, WINDOW)
    starts = starts[near[starts]]
    row = np.searchsorted(words.offsets, starts, "right") - 1
    high, low = one.windows(words, starts, WINDOW), two.windows(again, starts, WINDOW)
    return row, starts - words.offsets[row], high.view(np.int64), (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.diff(values, prepend=0).astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4").astype(np.int64))


def _extend(buckets: int):
    """Arrow function: (key, text, anchors) to windows, by hash bucket, and where they came from.

    `anchors` are the row's repeated ones. Windows around them are extended to their whole length and
    hashed to 96 bits. Of up to about BUFFER windows, those that occur more often than once are
    settled and leave as spans; one hash each tells the other tasks, so a frequent passage leaves a
    task once. Those that occur once ask for others. A bucket gets the hashes that ask, then those
    that tell; the batch's own row (bucket null) keeps the places of those that ask, by bucket.
    """

    def flush(keys: pa.Array, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        row, start, high, low = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(high, kind="stable")
        same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        after, before = np.append(same, False), np.append(False, same)
        alone, told = np.sort(order[~after & ~before]), order[after & ~before]
        settled = np.sort(order[after | before])
        bucket = ((high.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        alone = alone[np.argsort(bucket[alone], kind="stable")]
        told = told[np.argsort(bucket[told], kind="stable")]
        every = np.arange(buckets + 1)
        asks, tells = (np.searchsorted(bucket[x], every) for x in (alone, told))
        packed = np.empty(len(high), HASH)
        packed["high"], packed["low"] = high, low
        used = np.flatnonzero((np.diff(asks) > 0) | (np.diff(tells) > 0))
        hashes = [packed[np.concatenate([alone[asks[i]:asks[i + 1]], told[tells[i]:tells[i + 1]]])].tobytes() for i in used]
        n, batch = len(used), uuid.uuid4().bytes
        spans = (start[settled], row[settled])
        first_row, first, last = _spans(spans[1], spans[0])
        origin = [_packed(x) for x in (row[alone], start[alone], first_row, first, last)]
        return pa.RecordBatch.from_arrays([
            pa.array([batch] * (n + 1), pa.binary()), pa.array([*used.tolist(), None], pa.int32()),
            pa.array([*np.diff(asks)[used].tolist(), None], pa.int32()), pa.array([*hashes, None], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(keys)], pa.int32()), keys),
            pa.array([None] * n + [origin], pa.list_(pa.binary())),
        ], names=["batch", "bucket", "asks", "hashes", "keys", "origin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Scanner(seed=6), Scanner(seed=66)
        keys, found, rows, size = [], [], 0, 0
        for part in _parts(batches):
            row, *rest = _near_anchors(one, two, part)
            keys.append(part.column(0))
            found.append((row + rows, *rest))
            rows, size = rows + part.num_rows, size + len(row)
            if size > BUFFER:
                yield flush(pa.concat_arrays(keys), found)
                keys, found, rows, size = [], [], 0, 0
        if size:
            yield flush(pa.concat_arrays(keys), found)

    return run


def _match(parts: pa.Table) -> pa.Table:
    """The hashes of one bucket to a bit for each that asks: whether it occurs again."""
    blobs, asks = parts.column("hashes").to_pylist(), parts.column("asks").to_pylist()
    found = np.frombuffer(b"".join(blobs), HASH)
    high, low = found["high"].copy(), found["low"].copy()
    order = np.lexsort((low, high))
    same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    again = np.empty(len(found), bool)
    again[order] = np.append(same, False) | np.append(False, same)
    ends = np.cumsum([len(b) // HASH.itemsize for b in blobs])
    bits = [np.packbits(again[e - len(b) // HASH.itemsize:][:n]).tobytes() for e, b, n in zip(ends, blobs, asks)]
    return pa.table({"batch": parts.column("batch"), "bucket": parts.column("bucket"), "asks": parts.column("asks"), "bits": pa.array(bits, pa.binary())})


def _answered(origins: pa.Table, replies: pa.Table) -> pa.Table:
    """A batch's places and the replies of all buckets to (key, spans), for keys with repeated windows."""
    keys = origins.column("keys").combine_chunks().values
    row, start, first_row, first, last = (_unpacked(x) for x in origins.column("origin").to_pylist()[0])
    got = sorted(zip(replies.column("bucket").to_pylist(), replies.column("asks").to_pylist(), replies.column("bits").to_pylist()))
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in got]
    hit = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    row, start = row[hit], start[hit]
    order = np.lexsort((start, row))
    more = _spans(row[order], start[order])
    row, first, last = (np.concatenate(x) for x in zip((first_row, first, last), more))
    order = np.argsort(row, kind="stable")
    row, span = row[order], ((first << 32) + last)[order]
    used, begin = np.unique(row, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)), pa.int32()), pa.array(span, pa.int64()))
    keys = keys.take(pa.array(used, pa.int64()))
    return pa.table({"id": keys.field(0), "mark": keys.field(1), "spans": lists})


def _kept(texts: pa.Array, spans: list[np.ndarray]) -> tuple[list, list, list]:
    """Words, removed words and the remaining words joined by blanks, for each text.

    A span is the first and the last of consecutive starts, in the halves of a 64-bit integer.
    """
    data, rows = flat(texts)
    total, removed, kept = [], [], []
    for i, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
        words = data[a:b].tobytes().split()
        total.append(len(words))
        if not len(spans[i]):
            removed.append(0)
        else:
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, spans[i] >> 32, 1)
            np.add.at(marks, (spans[i] & 0xFFFFFFFF) + WINDOW, -1)
            covered = np.cumsum(marks)[:-1] > 0
            removed.append(int(covered.sum()))
            words = [w for w, c in zip(words, covered) if not c]
        kept.append(b" ".join(words))
    return total, removed, kept


def _cut(hashed: bool):
    """Arrow function: id, text and spans of repeated windows (may be null) to the remaining text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            column = part.column(2)
            values, rows = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            total, removed, kept = _kept(part.column(1), [values[a:b] for a, b in zip(rows[:-1], rows[1:])])
            last = pa.array([hashlib.sha256(k).hexdigest() for k in kept] if hashed else [k.decode() for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), last,
            ], names=["id", "n_words", "n_removed", "kept"])

    return run


def _mark(text: str) -> Column:
    """Tells texts under one id apart."""
    return F.hash(text)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, spans): where windows of 35 words begin whose words also begin elsewhere.

    Only texts with such a window; `mark` tells texts under one id apart, and a span is the first and
    the last of consecutive starts. Anchors stand at cover positions only, a fifth of the words. Any
    two places that share 35 words share an anchor. Anchors are counted, combined on the map side,
    and the repeated ones go back to their rows by a join that adaptive execution splits. Windows
    around them meet by hash, packed in buckets of about BUFFER; tasks have combined theirs before, so
    a passage may be in any share of the rows. No pairs are formed.
    """
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = T.StructType([T.StructField("id", kind), T.StructField("anchors", T.ArrayType(T.LongType()))])
    anchors = texts.mapInArrow(_find, found).where(F.size("anchors") > 0)
    anchors = anchors.select("id", F.explode("anchors").alias("anchor"))
    anchors = materialise(anchors, "anchors")
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    hits = anchors.join(often, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors"))
    hits = materialise(hits, "hits")
    release(docs.sparkSession, anchors)
    # Rows that repeat an id have the anchors of all of them; anchors that are not their own do nothing.
    near = texts.join(hits.withColumnRenamed("id", "wanted"), F.col("id").eqNullSafe(F.col("wanted")))
    near = near.select(F.struct("id", _mark("text").alias("mark")).alias("key"), "text", "anchors")
    windows = hits.agg(F.sum(F.size("anchors"))).first()[0] or 0
    windows = windows * PERIOD // len(COVER)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), windows // BUFFER)
    parts = near.mapInArrow(_extend(buckets), T.StructType([
        T.StructField("batch", T.BinaryType()), T.StructField("bucket", T.IntegerType()), T.StructField("asks", T.IntegerType()),
        T.StructField("hashes", T.BinaryType()), T.StructField("keys", T.ArrayType(near.schema["key"].dataType)),
        T.StructField("origin", T.ArrayType(T.BinaryType())),
    ]))
    parts = materialise(parts, "windows")
    release(docs.sparkSession, hits)
    replies = parts.where("bucket is not null").select("batch", "bucket", "asks", "hashes").groupBy("bucket")
    replies = replies.applyInArrow(_match, "batch binary, bucket int, asks int, bits binary")
    origins = parts.where("bucket is null").select("batch", "keys", "origin")
    spans = origins.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_answered, T.StructType([
        T.StructField("id", kind), T.StructField("mark", T.IntegerType()), T.StructField("spans", T.ArrayType(T.LongType())),
    ]))
    spans = materialise(spans.groupBy("id", "mark").agg(F.first("spans").alias("spans")), "spans")
    release(docs.sparkSession, parts)
    return spans


def remove_repeats(docs: DataFrame, hashed: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row without the words that a repeated window of 35 words covers.

    Returns the id, n_words, n_removed and kept: the remaining words joined by one blank, or with
    `hashed` its SHA-256. Windows are judged on the input. Null and empty texts have no words. Rows
    that repeat an id and text repeat each other's windows, as any two rows with equal texts do.
    """
    found = repeated_windows(docs, id_col, text_col)
    found = found.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (_mark("text") == F.col("_mark"))
    marked = texts.join(found, same, "left").select("id", "text", "spans")
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
    ])
    return marked.mapInArrow(_cut(hashed), schema).withColumnRenamed("id", id_col)

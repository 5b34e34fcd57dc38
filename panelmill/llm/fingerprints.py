"""Document fingerprints: invertible Bloom lookup tables of hashed paragraphs."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.scan import PIECE, Scanner, flat, mixed

#: Cells of a fingerprint; each retry has four times as many. Three cells hold a paragraph.
CELLS, GROWTH, HASHES = 24, 4, 3
#: A paragraph ends at a line or sentence end, else before about one word in RARE, and after LONGEST words.
RARE, LONGEST = 12, 16
#: Low bits of a digest hold the paragraph's length in bytes.
LENGTH_BITS = 16
ROWS = 400
#: Buckets in which neighbours by id are brought together, at most.
MOST_BUCKETS = 2000

CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])


def _check(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def digests(scanner: Scanner, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and digests of the paragraphs of whole texts: a hash of its words over its length.

    The n-th repeat of a paragraph within a text has a digest of its own, so digests are a set.
    """
    words = scanner.words(column)
    h, n = words.hashes, len(words.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data, _ = flat(column)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])[words.starts]
    begins = np.ones(n, bool)
    sentence = np.isin(data[words.ends - 1], np.frombuffer(b".!?", np.uint8))
    begins[1:] = (row[1:] != row[:-1]) | (lines[1:] != lines[:-1]) | sentence[:-1] | (h[1:] % np.uint64(RARE) == 0)
    first = np.flatnonzero(begins)
    begins[(np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))) % LONGEST == 0] = True
    first = np.flatnonzero(begins)
    last = np.append(first[1:], n)
    found = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(first, first[i] + PIECE - LONGEST)))
        a, b = first[i], last[j - 1]
        found[i:j] = scanner._between(h[a:b], first[i:j] - a, last[i:j] - a)
        i = j
    owner = row[first]
    order = np.lexsort((found, owner))
    same = np.concatenate([[False], (found[order][1:] == found[order][:-1]) & (owner[order][1:] == owner[order][:-1])])
    place = np.arange(len(order))
    repeat = np.empty(len(order), np.int64)
    repeat[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    size = np.minimum(words.ends[last - 1] - words.starts[first], (1 << LENGTH_BITS) - 1).astype(np.uint64)
    keys = mixed(found + repeat.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return owner, (keys >> np.uint64(LENGTH_BITS) << np.uint64(LENGTH_BITS)) | size


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """One cell of each third of a table for every key."""
    third = cells // HASHES
    h = mixed(keys ^ np.uint64(cells))
    return np.stack([((h >> np.uint64(20 * i)) % np.uint64(third)).astype(np.int64) + i * third for i in range(HASHES)])


def tables(rows: np.ndarray, keys: np.ndarray, count: int, cells: int) -> np.ndarray:
    """A table of `cells` cells for each of `count` rows."""
    out = np.zeros(count * cells, CELL)
    at = (rows * cells + _cells(keys, cells)).ravel()
    out["count"] = np.bincount(at, minlength=len(out))
    np.bitwise_xor.at(out["key"], at, np.tile(keys, HASHES))
    np.bitwise_xor.at(out["check"], at, np.tile(_check(keys), HASHES))
    return out.reshape(count, cells)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty_like(a)
    out["count"], out["key"], out["check"] = a["count"] - b["count"], a["key"] ^ b["key"], a["check"] ^ b["check"]
    return out


def peel(difference: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, digests and sides (1, -1) that subtracted tables yield, and which rows they empty.

    A cell that holds one digest gives it away; taking it from its other cells may free more.
    """
    count, cells = difference.shape
    flat_ = difference.ravel().copy()
    rows, keys, sides = [], [], []
    look = np.arange(len(flat_))
    while len(look):
        pure = look[np.abs(flat_["count"][look]) == 1]
        pure = pure[_check(flat_["key"][pure]) == flat_["check"][pure]]
        if not len(pure):
            break
        both = np.stack([(pure // cells).astype(np.uint64), flat_["key"][pure]])
        _, one = np.unique(both, axis=1, return_index=True)
        pure = pure[one]
        row, key, side = pure // cells, flat_["key"][pure].copy(), flat_["count"][pure].copy()
        rows.append(row)
        keys.append(key)
        sides.append(side)
        at = (row * cells + _cells(key, cells)).ravel()
        np.subtract.at(flat_["count"], at, np.tile(side, HASHES))
        np.bitwise_xor.at(flat_["key"], at, np.tile(key, HASHES))
        np.bitwise_xor.at(flat_["check"], at, np.tile(_check(key), HASHES))
        look = np.unique(at)
    left = flat_.reshape(count, cells)
    clean = ((left["count"] == 0) & (left["key"] == 0) & (left["check"] == 0)).all(axis=1)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), clean
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides), clean


class Prints:
    """Paragraphs of a list of texts and their fingerprints."""

    def __init__(self, scanner: Scanner, texts: list[str]):
        self.count = len(texts)
        self.rows, self.keys = digests(scanner, pa.array(texts, pa.large_string()))
        self.ends = np.searchsorted(self.rows, np.arange(self.count + 1))
        size = (self.keys & np.uint64((1 << LENGTH_BITS) - 1)).astype(np.int64)
        self.size = np.bincount(self.rows, size, self.count).astype(np.int64)
        self.tables = tables(self.rows, self.keys, self.count, CELLS)

    def texts(self) -> list[str]:
        """Fingerprints as text: paragraphs and their bytes, then the cells."""
        heads = np.stack([np.diff(self.ends), self.size], axis=1).astype("<u8")
        return [base64.b85encode(h.tobytes() + t.tobytes()).decode() for h, t in zip(heads, self.tables)]

    def larger(self, rows: np.ndarray, cells: int) -> np.ndarray:
        """Tables of `cells` cells of some rows."""
        keys = [self.keys[self.ends[r]:self.ends[r + 1]] for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
        return tables(owner, np.concatenate(keys), len(rows), cells)


def likeness(one: Prints, rows: np.ndarray, other: Prints, others: np.ndarray) -> np.ndarray:
    """Share of bytes in paragraphs that pairs of texts have in common: 1 for equal ones.

    Fingerprints are subtracted and peeled; pairs that do not empty are tried again with larger
    tables until all differing paragraphs are known.
    """
    total = (one.size[rows] + other.size[others]).astype(float)
    out = np.ones(len(rows))
    left, cells = np.arange(len(rows)), CELLS
    difference = subtract(one.tables[rows], other.tables[others])
    while len(left):
        at, keys, _, clean = peel(difference)
        differing = np.bincount(at, (keys & np.uint64((1 << LENGTH_BITS) - 1)).astype(float), len(left))
        done = left[clean]
        out[done] = 1 - differing[clean] / np.maximum(total[done], 1)
        left = left[~clean]
        cells *= GROWTH
        if len(left):
            difference = subtract(one.larger(rows[left], cells), other.larger(others[left], cells))
    return np.clip(out, 0, 1)


def edited(text: str, following: str) -> str:
    """`text` whose last half is replaced by as much of the beginning of `following`."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function over (bucket, ghost, id, text), sorted: each row with the one that follows it.

    A bucket ends with ghosts, the first rows of the next one, which only lend their text.
    """
    scanner = Scanner(seed=2)

    def out(ids: pa.Array, texts: list[str], follows: np.ndarray) -> pa.RecordBatch:
        # ids[i] has texts[i], and texts[follows[i]] comes next
        n = len(ids)
        changed = [edited(texts[i], texts[j]) for i, j in zip(range(n), follows)]
        base, new = Prints(scanner, texts), Prints(scanner, changed)
        own = np.arange(n)
        return pa.RecordBatch.from_arrays([
            ids, pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(base.texts()[:n], pa.string()), pa.array(new.texts(), pa.string()),
            pa.array(likeness(base, own, new, own)), pa.array(likeness(base, own, base, follows)),
        ], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    held = None  # the last row seen, whose next one is not known yet
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            buckets, ghosts = part.column(0).to_pylist(), part.column(1).to_pylist()
            texts = [t or "" for t in part.column(3).to_pylist()]
            ids = part.column(2)
            if held is not None:
                buckets, ghosts, texts = [held[0], *buckets], [False, *ghosts], [held[2], *texts]
                ids = pa.concat_arrays([held[1], ids])
            held = None
            rows, follows = [], []
            for i in range(len(buckets)):
                if ghosts[i]:
                    continue
                if i + 1 < len(buckets):
                    rows.append(i)
                    follows.append(i + 1)
                else:
                    held = (buckets[i], ids.slice(i, 1), texts[i])
            if rows:
                place = {r: k for k, r in enumerate(rows)}
                extra = [j for j in follows if j not in place]
                place |= {j: len(rows) + k for k, j in enumerate(extra)}
                used = [texts[i] for i in rows] + [texts[j] for j in extra]
                yield out(ids.take(pa.array(rows, pa.int64())), used, np.array([place[j] for j in follows]))
    if held is not None:
        raise ValueError("a bucket has no ghost")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by as many of the next row's first
    (or all), rows by descending id and after the last the first. Null texts are empty. Null ids come
    last; rows that repeat an id follow each other by text. A single row is its own next.

    Rows are dealt over ranges of ids so that neighbours meet; only the first id of each range reaches
    the driver. The first row of a range also goes to the end of the range before. Texts move once.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = min(MOST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.col("id").desc_nulls_last()
    heads = rows.select("id").repartitionByRange(buckets, order).groupBy(F.spark_partition_id().alias("p"))
    heads = sorted({r["top"] for r in heads.agg(F.max("id").alias("top")).collect() if r["top"] is not None}, reverse=True)
    if not heads:  # no rows, or null ids only
        heads = [None]
    if heads[0] is None:
        bucket, first = F.lit(0), F.lit(True)
    else:
        all_heads: Column = F.array(*[F.lit(h).cast(kind) for h in heads])
        above = F.size(F.filter(all_heads, lambda s: s >= F.col("id"))) - 1
        bucket = F.when(F.col("id").isNull(), len(heads) - 1).otherwise(above)
        first = F.coalesce(F.array_contains(all_heads, F.col("id")), F.lit(False))
    before = F.pmod(F.col("bucket") - 1, F.lit(len(heads)))
    places = F.when(first, F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost")), F.struct(before.alias("bucket"), F.lit(True).alias("ghost"))
    )).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))))
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("place", F.explode(places))
    rows = rows.select(F.col("place.bucket").alias("bucket"), F.col("place.ghost").alias("ghost"), "id", "text")
    dealt = rows.repartition(max(1, buckets // 4), "bucket").sortWithinPartitions("bucket", "ghost", order, "text")
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])
    return dealt.mapInArrow(_prints, schema).withColumnRenamed("id", id_col)

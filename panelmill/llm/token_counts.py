"""Token counts of whole texts: a broadcast table of frequent pre-token lengths before a cache in each worker.

A pre-token is a run of blanks with the run of other bytes after it. Tokens never reach over its ends
(checked against the vocabulary), so a text has as many tokens as its pre-tokens together. Pre-tokens
stay in the task that reads them: only bounded sketches of their frequencies leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.scan import Scanner, flat, mixed

#: Entries of the broadcast table (18 bytes each, half of the slots free) and of each task's sketch.
TABLE = 32768
#: Longest pre-token, in bytes, that the table and the caches hold; longer ones are encoded each time.
SHORT = 64
#: Pre-tokens that a worker's cache holds before it forgets those it has not met lately.
CACHED = 600_000
#: Bytes of text scanned at once; a longer text is cut between two pre-tokens.
STEP = 1 << 20
#: Sketches merged by one task.
FAN = 16
BLANK = 0x20
MARK = "▁"


class Pieces:
    """A sentencepiece model whose pieces allow counting by pre-token; any other raises ValueError.

    Needed: text is taken as it is, with one blank put before it and each blank as a mark; no piece has
    a mark after another character; line feeds are in no piece, so they stand alone as a byte.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size) if not self.model.is_byte(i)]
        seen = set("".join(pieces))
        self.barriers = [b for b in (0x09, 0x0A, 0x0B, 0x0C) if chr(b) not in seen]
        sample = " a  Áﬁ\n "
        as_it_is = self.model.normalize(sample) == (" " + sample).replace(" ", MARK)
        if not as_it_is or 0x0A not in self.barriers or any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("token counts by pre-token need a model that keeps text and splits before blanks")

    def whole(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def lengths(self, pretokens: list[bytes]) -> list[int]:
        """Tokens of each pre-token; the line feed before it takes the model's own blank (two tokens)."""
        return [n - 2 for n in self.whole(["\n" + p.decode() for p in pretokens])]


def _cuts(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where parts of at most about STEP bytes begin, and the row of each; parts begin with pre-tokens."""
    starts, owners = [], []
    for row in range(len(rows) - 1):
        at, end = int(rows[row]), int(rows[row + 1])
        starts.append(at)
        owners.append(row)
        while end - at > STEP:
            reach, cut = at + STEP, None
            while cut is None and reach < end:
                window = data[reach - 1:min(reach + STEP, end)] == BLANK
                found = np.flatnonzero(window[1:] & ~window[:-1])
                cut = reach + int(found[0]) if len(found) else None
                reach += STEP
            if cut is None:
                break
            at = cut
            starts.append(at)
            owners.append(row)
    return np.array(starts + [len(data)], np.int64), np.array(owners, np.int64)


class Found:
    """Pre-tokens of a slice: their keys, blanks, bytes [start, end) after the blanks, and parts."""

    def __init__(self, data, keys, blanks, starts, ends, owner):
        self.data, self.keys, self.blanks, self.starts, self.ends, self.owner = data, keys, blanks, starts, ends, owner

    def text(self, i: int) -> bytes:
        return b" " * int(self.blanks[i]) + self.data[self.starts[i]:self.ends[i]].tobytes()

    @property
    def sizes(self) -> np.ndarray:
        return self.blanks + self.ends - self.starts

    def checks(self, places: np.ndarray) -> np.ndarray:
        """A second hash, of the first and last eight bytes: with the key, as good as the bytes themselves."""
        start, end = self.starts[places, None], self.ends[places, None]
        out = (end - start)[:, 0].astype(np.uint64)
        for at in (start + np.arange(8), end - 8 + np.arange(8)):
            inside = (at >= start) & (at < end)
            eight = np.where(inside, self.data[np.clip(at, 0, len(self.data) - 1)], 0).astype(np.uint8)
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + eight.view(np.uint64)[:, 0])
        return out


class Splitter:
    """Finds pre-tokens by array operations."""

    def __init__(self, barriers: list[int]):
        self.scanner = Scanner(seed=12)
        self.barrier = np.zeros(256, bool)
        self.barrier[barriers] = True
        self.scanner.space = self.barrier.copy()
        self.scanner.space[BLANK] = True

    def __call__(self, data: np.ndarray, parts: np.ndarray, head: np.ndarray) -> tuple[Found, np.ndarray]:
        """Pre-tokens of the parts data[parts[i]:parts[i + 1]], and each part's number of barriers.

        `head` marks parts that begin a text: the model puts a blank before them.
        """
        column = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(parts), pa.py_buffer(data)])
        words = self.scanner.words(column)
        n, full = len(data), np.diff(parts) > 0
        blank = data == BLANK
        solid = np.maximum.accumulate(np.where(blank, -1, np.arange(n)))
        wall = self.barrier[data]
        follows = np.ones(n, bool)
        follows[:-1] = wall[1:]
        follows[parts[1:][full] - 1] = True
        runs = np.flatnonzero(blank & follows)  # blanks with no word after them
        bare = np.flatnonzero(full & head & wall[np.minimum(parts[:-1], n - 1)])  # texts that begin with a barrier
        last = np.concatenate([words.starts - 1, runs])
        owner = np.searchsorted(parts, np.concatenate([words.starts, runs]), "right") - 1
        before = np.maximum(np.where(last >= 0, solid[last], -1), parts[owner] - 1)
        blanks = last - before + ((before == parts[owner] - 1) & head[owner])
        starts, ends = np.concatenate([words.starts, runs + 1]), np.concatenate([words.ends, runs + 1])
        hashes = np.concatenate([words.hashes, np.zeros(len(runs) + len(bare), np.uint64)])
        blanks = np.concatenate([blanks, np.ones(len(bare), np.int64)])
        starts, ends = (np.concatenate([x, parts[bare]]) for x in (starts, ends))
        owner = np.concatenate([owner, bare])
        keys = mixed(hashes + blanks.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        keys[keys == 0] = 1
        walls = np.concatenate([[0], np.cumsum(wall)])
        return Found(data, keys, blanks, starts, ends, owner), walls[parts[1:]] - walls[parts[:-1]]


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, parts, head, row) of slices of about STEP bytes of a text column."""
    data, rows = flat(column)
    if not len(data):
        return
    starts, owners = _cuts(data, rows)
    a = 0
    while a < len(owners):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + STEP, "right")) - 1)
        row = owners[a:b]
        head = np.diff(row, prepend=owners[a - 1] if a else -1) > 0
        yield data[starts[a]:starts[b]], starts[a:b + 1] - starts[a], head, row
        a = b


class Table:
    """Open-addressed table of 64-bit keys and lengths.

    Keys are hashes of pre-tokens of at most SHORT bytes; another pre-token meets one of TABLE entries by
    chance with a probability of 2**-49.
    """

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.lengths = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint16)
        for key, length in zip(keys, lengths):
            at = int(key >> self.shift)
            while self.keys[at]:
                at = (at + 1) & self.mask
            self.keys[at], self.lengths[at] = key, length

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Length of each key, -1 where the table has none."""
        out = np.full(len(keys), -1, np.int64)
        open_, at = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.lengths[at[hit]]
            on = ~hit & (there != 0)
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out


class Frequent:
    """Misra-Gries summary of weighted keys: at most `size` counters, each with the length of its pre-token."""

    def __init__(self, size: int):
        self.size = size
        self.keys, self.counts, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def add(self, keys: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> None:
        """Adds ascending distinct `keys`; a length of 0 is unknown."""
        at = np.searchsorted(self.keys, keys)
        there = self._there(keys, at)
        self.counts[at[there]] += counts[there]
        self.lengths[at[there]] = np.maximum(self.lengths[at[there]], lengths[there])
        new, where = ~there, at[~there]
        self.keys, self.counts = np.insert(self.keys, where, keys[new]), np.insert(self.counts, where, counts[new])
        self.lengths = np.insert(self.lengths, where, lengths[new])

    def _there(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return there

    def _length(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        there = self._there(keys, at)
        out = np.full(len(keys), -1, np.int64)
        out[there] = self.lengths[at[there]]
        return out

    def known(self, keys: np.ndarray) -> np.ndarray:
        return self._length(keys) > 0

    def unknown(self, keys: np.ndarray) -> np.ndarray:
        """Which of `keys` have a counter but no length."""
        return self._length(keys) == 0

    def trim(self) -> None:
        if len(self.keys) > self.size:
            least = np.partition(self.counts, -self.size - 1)[-self.size - 1]
            kept = self.counts > least
            self.keys, self.lengths, self.counts = self.keys[kept], self.lengths[kept], self.counts[kept] - least

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (self.keys, self.counts, self.lengths)], names=["keys", "counts", "lengths"]
        )

    def take(self, keys: bytes, counts: bytes, lengths: bytes) -> None:
        self.add(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(lengths, np.uint16))
        self.trim()


SKETCH = "keys binary, counts binary, lengths binary"


class Cache:
    """Lengths of the pre-tokens that a worker has met, found by a 128-bit key; all but the latest are forgotten."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.now = pieces, 0
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.lengths, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, found: Found, places: np.ndarray) -> np.ndarray:
        """Length of the pre-tokens at `places`, whose keys ascend."""
        self.now += 1
        keys, checks = found.keys[places], found.checks(places)
        out = np.zeros(len(places), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        there = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        hit = there.copy()
        hit[there] = self.checks[at[there]] == checks[there]
        out[hit] = self.lengths[at[hit]]
        self.met[at[hit]] = self.now
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] = self.pieces.lengths([found.text(i) for i in places[miss]])
            new = np.flatnonzero(~there & (found.sizes[places] <= SHORT))
            where = np.searchsorted(self.keys, keys[new])
            self.keys, self.checks = np.insert(self.keys, where, keys[new]), np.insert(self.checks, where, checks[new])
            self.lengths, self.met = np.insert(self.lengths, where, out[new]), np.insert(self.met, where, self.now)
            if len(self.keys) > CACHED:
                kept = self.met > np.partition(self.met, len(self.met) // 2)[len(self.met) // 2] - 1
                kept &= np.cumsum(kept[::-1])[::-1] <= CACHED
                self.keys, self.checks, self.lengths, self.met = (x[kept] for x in (self.keys, self.checks, self.lengths, self.met))
        return out


def _sketched(model: bytes, size: int):
    """Arrow function: texts to one row, the task's summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        split, cache, state = Splitter(pieces.barriers), Cache(pieces), Frequent(size)
        for batch in batches:
            for data, parts, head, _ in _slices(batch.column(0)):
                found, _ = split(data, parts, head)
                short = np.flatnonzero(found.sizes <= SHORT)
                keys, first, counts = np.unique(found.keys[short], return_index=True, return_counts=True)
                # Only what comes again is encoded: most of a text's distinct pre-tokens are rare ones.
                again = state.unknown(keys) | (counts > 1) & ~state.known(keys)
                lengths = np.zeros(len(keys), np.uint16)
                lengths[again] = cache(found, short[first[again]])
                state.add(keys, counts, lengths)
                if len(state.keys) > 2 * size:
                    state.trim()
        state.trim()
        if len(state.keys):
            yield state.row()

    return run


def _merged(size: int):
    """Arrow function: summaries to the one of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Frequent(size)
        for batch in batches:
            for row in batch.to_pylist():
                state.take(**row)
        if len(state.keys):
            yield state.row()

    return run


def frequent(docs: DataFrame, model_path: str, size: int = TABLE, text_col: str = "text") -> Table:
    """The table of the `size` most frequent pre-tokens of all texts of `docs`, and their lengths.

    Every task summarises all its texts in `size` counters; summaries, one row each, are merged in a tree,
    and at most FAN of them reach the driver. A pre-token that makes up more than one in `size` of all
    is among them for certain; which others are affects speed alone.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    Pieces(model)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    sketches, rows = texts.mapInArrow(_sketched(model, size), SKETCH), texts.rdd.getNumPartitions()
    while rows > FAN:
        rows = math.ceil(rows / FAN)
        sketches = sketches.repartition(rows).mapInArrow(_merged(size), SKETCH)
    state = Frequent(size)
    for row in sorted(sketches.collect()):
        state.take(*map(bytes, row))
    known = state.lengths > 0
    return Table(state.keys[known], state.lengths[known])


def _counted(model: bytes, table):
    """Arrow function: id and text to id, bytes and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, lookup = Pieces(model), table.value
        split, cache = Splitter(pieces.barriers), Cache(pieces)
        mark = MARK.encode()
        for batch in batches:
            texts = batch.column(1)
            _, rows = flat(texts)
            total = np.zeros(batch.num_rows, np.int64)
            odd = set()
            for data, parts, head, row in _slices(texts):
                found, walls = split(data, parts, head)
                lengths = lookup(found.keys)
                lengths[found.sizes > SHORT] = -1
                missed = np.flatnonzero(lengths < 0)
                if len(missed):
                    _, first, place = np.unique(found.keys[missed], return_index=True, return_inverse=True)
                    lengths[missed] = cache(found, missed[first])[place]
                sums = np.bincount(found.owner, lengths, len(head)).astype(np.int64) + walls
                np.add.at(total, row, sums)
                if mark in data.tobytes():
                    odd.update(r for r, a, b in zip(row.tolist(), parts[:-1], parts[1:]) if mark in data[a:b].tobytes())
            for r in odd:  # a mark in a text is a blank to the model, wherever it stands
                total[r] = pieces.whole([texts[r].as_py()])[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(rows)), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, table: Table | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) for every row of `docs`.

    Tokens are those of the sentencepiece model at `model_path` over the whole text, without added ones.
    `table` is what `frequent` returns, made from `docs` if not given; it is bounded by TABLE entries and
    broadcast. Null and empty texts have no bytes and no tokens. Rows are counted one by one, so null or
    repeated ids and repeated rows stay as they are; other columns are ignored, whatever their names.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(table or frequent(docs, model_path, text_col=text_col))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
    ])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_counted(model, shared), schema).withColumn("over_limit", F.col("n_tokens") > limit)

"""Hard negatives by exact scores, over blocks of vectors in the order of a Hilbert curve.

Neighbours on the curve share a block, and each block knows the smallest and largest value of every
dimension. Interval arithmetic on those bounds the scores that an anchor can reach in a block, so blocks that
cannot hold one of its best positives, or a score in one of its windows, are not read for it. Anchors (crews)
and blocks (areas) meet in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.session import materialise

#: Rows of a block, blocks of an area and anchors of a crew (about).
BLOCK, AREA, CREW = 512, 64, 2048
#: Whole numbers below this are exact as floating-point numbers, also times 100.
EXACT = 2**46


def hilbert_keys(values: np.ndarray) -> list[bytes]:
    """Places of the rows of `values` on a Hilbert curve over all dimensions, two bits each.

    A value's bits are its sign and whether it is far from zero for its row. Axes are turned into the curve's
    transposed index plane by plane, for all rows at once.
    """
    n, dims = values.shape
    far = 0.67 * np.sqrt(np.square(values.astype(float)).mean(axis=1, keepdims=True))
    x = ((values >= 0).astype(np.uint8) + (values >= far) + (values >= -far)).T.copy()
    for i in range(dims):  # undo excess work of the upper plane: exchange or invert the lower bit
        upper = (x[i] & 2) > 0
        swapped = np.where(upper, 0, (x[0] ^ x[i]) & 1).astype(np.uint8)
        x[0] ^= swapped | upper
        x[i] ^= swapped
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    x ^= ((x[-1] & 2) >> 1)[None, :]
    bits = np.concatenate([x >> 1, x & 1]).T
    return [row.tobytes() for row in np.packbits(bits, axis=1)]


def _matrix(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _stored(values: np.ndarray) -> bytes:
    """Values in as few bytes as they need."""
    kind = next(k for k in (np.int16, np.int32, np.int64) if (np.abs(values) <= np.iinfo(k).max).all())
    return values.astype(kind).tobytes()


def _read(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (rows * dims)]).reshape(rows, dims)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds dims and key to id, label, q."""
    for batch in batches:
        rows = _matrix(batch.column(2))
        dims = np.array([len(r) for r in rows], np.int32)
        keys: list = [None] * len(rows)
        for d in np.unique(dims):
            some = np.flatnonzero(dims == d)
            for i, key in zip(some, hilbert_keys(np.stack([rows[i] for i in some]))):
                keys[i] = key
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(keys, pa.binary())], names=["id", "label", "q", "dims", "key"])


BLOCKS = "block long, dims int, n int, ids array<long>, labels array<long>, data binary, mins array<long>, maxs array<long>"


def _blocked(size: int):
    """Arrow function: sorted rows to blocks of up to `size`; a block's number is also that of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        ids, labels, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def block(n: int) -> pa.RecordBatch:
            nonlocal ids, labels, rows, first
            order = np.argsort(ids[:n], kind="stable")
            q = np.stack(rows[:n])[order]
            out = [[first], [q.shape[1]], [n], [ids[:n][order]], [labels[:n][order]], [_stored(q)], [q.min(axis=0)], [q.max(axis=0)]]
            ids, labels, rows = ids[n:], labels[n:], rows[n:]
            first += n
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), *2 * [pa.list_(pa.int64())]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            labels = np.concatenate([labels, batch.column(1).to_numpy()])
            rows = rows + _matrix(batch.column(2))
            while len(rows) > size or rows and len(rows[0]) != len(rows[-1]):
                yield block(next((i for i, r in enumerate(rows[:size]) if len(r) != len(rows[0])), size))
        while rows:
            yield block(min(size, len(rows)))

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    kind = float if most < EXACT else np.int64
    return a.astype(kind) @ b.astype(kind).T


def _bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest inner product of the rows of `a` with any vector between `low` and `high`."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    ends = np.stack([low, high])
    low_plus, high_plus = _products(plus, ends).T
    low_minus, high_minus = _products(minus, ends).T
    return low_plus + high_minus, high_plus + low_minus


class Best:
    """The `k` best (score, smaller id first) of each query seen so far."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.least = k, floor.copy()
        self.query, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        new = (query, score, id_, row)
        old = (self.query, self.score, self.id, self.row)
        query, score, id_, row = (np.concatenate([x, y.astype(np.int64)]) for x, y in zip(old, new))
        order = np.lexsort((row, id_, -score, query))
        query, score, id_, row = (x[order] for x in (query, score, id_, row))
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.score, self.id, self.row = (x[kept] for x in (query, score, id_, row))
        full = place == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])


ANCHORS = "anchor long, anchor_id long, dims int, label long, q binary, least long"
NONE = np.iinfo(np.int64).min


def _anchors(every: int, k: int):
    """Arrow function: blocks to the anchors among their rows.

    `least` is the k-th best score of the anchor's label in its own block: the k best are no worse.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                ids, labels = np.array(block["ids"], np.int64), np.array(block["labels"], np.int64)
                q = _read(block["data"], block["n"], block["dims"])
                mine = np.flatnonzero(ids % every == 0)
                if not len(mine):
                    continue
                scores = _products(q[mine], q)
                least = np.full(len(mine), NONE)
                for i, m in enumerate(mine):
                    own = scores[i][(labels == labels[m]) & (np.arange(len(ids)) != m)]
                    if len(own) >= k:
                        least[i] = np.partition(own, -k)[-k]
                n = len(mine)
                yield pa.RecordBatch.from_arrays([
                    pa.array(block["block"] + mine), pa.array(ids[mine]), pa.array([block["dims"]] * n, pa.int32()), pa.array(labels[mine]),
                    pa.array([_stored(q[m]) for m in mine], pa.binary()), pa.array(least),
                ], names=[c.split()[0] for c in ANCHORS.split(", ")])

    return run


class Crew:
    """Anchors of a cell, by number of dimensions, with their queries.

    Without windows an anchor has one query: its best of the same label. With windows it has one for each:
    its best of other labels between `low` and `high` percent of the positive's score.
    """

    def __init__(self, table: pa.Table, windows: bool, k: int, low: int, high: int):
        self.windows, self.low, self.high = windows, low, high
        self.rows, self.labels = table["anchor"].to_numpy(), table["label"].to_numpy()
        data, dims = table["q"].to_pylist(), table["dims"].to_numpy()
        self.by = {}
        for d in np.unique(dims):
            some = np.flatnonzero(dims == d)
            self.by[int(d)] = some, np.concatenate([_read(data[i], 1, d).astype(np.int64) for i in some])
        if windows:
            scores = _matrix(table["windows"])
            self.owner = np.repeat(np.arange(len(scores)), [len(s) for s in scores])
            self.window = np.concatenate(scores) if scores else np.zeros(0, np.int64)
            least = -(-self.window * low // 100)
        else:
            self.owner, least = np.arange(len(self.rows)), table["least"].to_numpy()
        self.best = Best(k, least)

    def wanted(self, dims: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries that a block with these bounds may add to, and the place of their anchor in by[dims]."""
        if dims not in self.by:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some, a = self.by[dims]
        least, most = _bounds(a, low, high)
        place = np.full(len(self.rows), -1)
        place[some] = np.arange(len(some))
        queries = np.flatnonzero(place[self.owner] >= 0)
        at = place[self.owner[queries]]
        able = most[at] >= self.best.least[queries]
        if self.windows:
            able &= 100 * least[at] <= self.high * self.window[queries]
        return queries[able], at[able]

    def read(self, block: dict) -> None:
        queries, at = self.wanted(block["dims"], np.array(block["mins"]), np.array(block["maxs"]))
        if not len(queries):
            return
        used, place = np.unique(at, return_inverse=True)
        q = _read(block["data"], block["n"], block["dims"])
        ids, labels = np.array(block["ids"], np.int64), np.array(block["labels"], np.int64)
        rows = block["block"] + np.arange(len(ids))
        scores = _products(self.by[block["dims"]][1][used], q)
        for a in range(0, len(queries), CREW):
            some, one = queries[a:a + CREW], place[a:a + CREW]
            owner, found = self.owner[some], scores[one]
            same = labels[None, :] == self.labels[owner][:, None]
            if self.windows:
                fits = ~same & (found >= self.best.least[some][:, None]) & (100 * found <= self.high * self.window[some][:, None])
            else:
                fits = same & (rows[None, :] != self.rows[owner][:, None]) & (found >= self.best.least[some][:, None])
            i, j = np.nonzero(fits)
            self.best.add(some[i], found[i, j], ids[j], rows[j])


FOUND = "anchor long, window long, id long, row long, score long"


def _chosen(windows: bool, low: int, high: int):
    """Cogroup function: zone maps and anchors of a cell to the blocks that any of the anchors must read."""

    def run(zones: pa.Table, anchors: pa.Table) -> pa.Table:
        crew = Crew(anchors, windows, 1, low, high)
        kept = [len(crew.wanted(z["dims"], np.array(z["mins"]), np.array(z["maxs"]))[0]) > 0 for z in zones.select(["dims", "mins", "maxs"]).to_pylist()]
        return zones.select(["block", "crew"]).filter(pa.array(kept, pa.bool_()))

    return run


def _searched(windows: bool, k: int, low: int, high: int):
    """Cogroup function: blocks and anchors of a cell to FOUND."""

    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        crew = Crew(anchors, windows, k, low, high)
        for block in blocks.to_batches(max_chunksize=1):
            crew.read(block.to_pylist()[0])
        best = crew.best
        window = crew.window[best.query] if windows else np.zeros(len(best.query), np.int64)
        columns = [crew.rows[crew.owner[best.query]], window, best.id, best.row, best.score]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _search(blocks: DataFrame, anchors: DataFrame, windows: bool, k: int, low: int, high: int) -> DataFrame:
    """FOUND rows: for every query of `anchors` its `k` best of every cell, of the blocks chosen for it.

    Blocks go to each crew that must read them, anchors to each area; both counts follow from the tables.
    """
    areas = max(1, -(-blocks.count() // AREA))
    crews = max(1, -(-anchors.count() // CREW))
    place = F.pmod(F.xxhash64("block"), F.lit(areas)).alias("area")
    team = F.pmod(F.xxhash64("anchor"), F.lit(crews)).alias("crew")
    cells = ["area", "crew"]
    everywhere = anchors.select("*", team, _each(areas).alias("area"))
    zones = blocks.select("block", "dims", "mins", "maxs", place, _each(crews).alias("crew"))
    chosen = zones.groupBy(*cells).cogroup(everywhere.groupBy(*cells)).applyInArrow(_chosen(windows, low, high), "block long, crew long")
    read = blocks.join(chosen, "block").select("*", place)
    return read.groupBy(*cells).cogroup(everywhere.groupBy(*cells)).applyInArrow(_searched(windows, k, low, high), FOUND)


def _rank(by: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "row"))


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels within a window of scores.

    Components become floor(scale * x), scores are integer inner products, higher first, ties by smaller id.
    Anchors are rows whose id is divisible by `every`; their positives are the first `positives` other rows of
    the same label; the negatives of a positive with score p are the first `negatives` rows of other labels
    with low * p <= 100 * score <= high * p. Returns anchor_id, positive_id, rank, negative_id,
    positive_score and negative_score, of every anchor against all rows, exactly.

    Rows with a null id, label or vector, with a null or non-finite component or without components take no
    part; vectors of different lengths do not meet. Rows that repeat an id are rows of their own (an anchor's
    own row is no positive, its repetition is), in the order in which they were stored. Scores have to fit
    64 bits. Other columns are ignored. An empty table gives no rows.
    """
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = vectors.schema[label_col].dataType
    label = F.col(label_col).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(label_col)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector_col) > 0) & sound)
    whole = F.transform(vector_col, lambda x: F.floor(scale * x.cast("double")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), whole.alias("q"))
    keyed = rows.mapInArrow(_keyed, "id long, label long, q array<long>, dims int, key binary")
    # Ids tell equal vectors apart, so that any number of copies is dealt over tasks.
    ordered = keyed.repartitionByRange("dims", "key", "id").sortWithinPartitions("dims", "key", "id")
    blocks = materialise(ordered.select("id", "label", "q").mapInArrow(_blocked(BLOCK), BLOCKS), "blocks")
    anchors = materialise(blocks.mapInArrow(_anchors(every, positives), ANCHORS), "anchors")

    best = _search(blocks, anchors, False, positives, low, high).withColumn("place", _rank(["anchor"]))
    best = materialise(best.where(F.col("place") <= positives).select("anchor", "id", "row", "score"), "positives")
    windows = best.where("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_set("score")).alias("windows"))
    found = _search(blocks, materialise(anchors.join(windows, "anchor"), "windows"), True, negatives, low, high)
    found = found.withColumn("rank", _rank(["anchor", "window"])).where(F.col("rank") <= negatives)
    names = anchors.select("anchor", "anchor_id").join(best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("window")), "anchor")
    return names.join(found, ["anchor", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("window").alias("positive_score"), F.col("score").alias("negative_score"),
    )

"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning of their ends.

The ends of both token sequences, as byte offsets, are two ascending lists. Binary searches along diagonals
cut their merge into pieces of equal work, which are merged independently; where a piece ends between two
equal ends, the neighbours are stitched. Every distinct end closes one overlap of an A and a B token, and an
end that both have closes a group. How many documents link a pair of ids is counted per block of documents
first, so that the shuffle carries a row for each pair and block, not for each pair and document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.scan import flat
from panelmill.session import materialise

#: Ends merged by one piece.
PIECE = 1 << 16
#: Characters of text encoded together; a longer text is cut between two words.
STEP = 1 << 19
#: Overlaps gathered before a block of documents ends.
BLOCK = 1 << 20
#: Both tokenizers start a token at a single blank between two characters of words, whatever they are. The
#: second one writes a blank as U+2581, so that one counts as a blank where it stands in a text.
BETWEEN = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
EDGE = frozenset(c for c in map(chr, range(0x10000)) if c.isspace()) | {"▁"}
#: Words whose ids a worker remembers before it forgets those not met lately, and their longest.
CACHED, SHORT = 300_000, 64
#: Fixed value: how byte-level tokenizers split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_decoder() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_rank(spec: dict, decode: dict[str, int]):
    """The tokenizer of the file `spec` as ranks of byte strings, which encode several times faster to the same
    ids; None if the file does more than split bytes and merge in the order of its ids."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not (spec["normalizer"] or spec["truncation"] or spec["padding"])
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    if not plain or any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    from tiktoken import Encoding

    ranks = {bytes(map(decode.__getitem__, t)): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
    return Encoding("by-rank", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """Ids by A (byte-level, of blank + text) and B (sentencepiece, of text), and the bytes of each id."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        decode = _byte_decoder()
        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.ranks = _by_rank(json.loads(a), decode)
        self.b = SentencePieceProcessor(model_proto=b)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(decode[c] for c in token) if all(c in decode for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids have to be below 65536")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # With an id for each byte, A spells any text, and B whatever it makes of one before it splits it.
        self.a_complete = self.ranks is not None and {bytes([i]) for i in range(256)} <= set(self.a_bytes)
        self.new, self.old = ({}, {}), ({}, {})
        self.b_complete = sum(self.b.is_byte(i) for i in range(self.b.get_piece_size())) == 256

    def _encode(self, words: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Both sequences of ids, 16 bits each, of blank + word."""
        if self.ranks:
            first = [self.ranks.encode_ordinary(" " + w) for w in words]
        else:
            first = [x.ids for x in self.a.encode_batch([" " + w for w in words], add_special_tokens=False)]
        second = self.b.encode(words, num_threads=1)
        return [array("H", a).tobytes() for a in first], [array("H", b).tobytes() for b in second]

    def _learn(self, words: set[str]) -> None:
        """Remembers the ids of `words`, but for long ones and those that have white space at an edge."""
        if len(self.new[0]) > CACHED:
            self.old, self.new = self.new, ({}, {})
        missing = words - self.new[0].keys()
        met = missing & self.old[0].keys()
        for new, old in zip(self.new, self.old):
            new.update((w, old[w]) for w in met)
        missing = [w for w in missing - met if 0 < len(w) <= SHORT and w[0] not in EDGE and w[-1] not in EDGE]
        for new, ids in zip(self.new, self._encode(missing)):
            new.update(zip(missing, ids))

    def _spelt(self, text: str, a: bytes, b: bytes) -> bool:
        """Whether both sequences of ids spell blank + text."""
        whole = " " + text
        a_right = self.a_complete or whole.encode() == b"".join(map(self.a_bytes.__getitem__, np.frombuffer(a, np.uint16)))
        if self.b_complete:
            return a_right and self.b.normalize(text).replace("▁", " ") == whole
        return a_right and whole.encode() == b"".join(map(self.b_bytes.__getitem__, np.frombuffer(b, np.uint16)))

    def __call__(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Both sequences of ids of each text; None where they do not spell blank + text."""
        split = [t.split(" ") for t in texts]
        self._learn(set().union(*split))
        out = []
        for text, words in zip(texts, split):
            a_ids = list(map(self.new[0].get, words))
            if None in a_ids:  # blanks in a row, white space at an edge of a word, or long words
                words = BETWEEN.split(text)
                a_ids, b_ids = (list(map(new.get, words)) for new in self.new)
                rest = [i for i, x in enumerate(a_ids) if x is None]
                for i, x, y in zip(rest, *self._encode([words[i] for i in rest])):
                    a_ids[i], b_ids[i] = x, y
            else:
                b_ids = map(self.new[1].__getitem__, words)
            ids = b"".join(a_ids), b"".join(b_ids)
            out.append(ids if self._spelt(text, *ids) else None)
        return out


def diagonals(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in the ascending lists, i + j = 0, size, 2 * size, ..., at which their merge can be cut.

    Each is found by a binary search of its own along its diagonal: all before i and j come before the
    rest, with an element of `a` before an equal one of `b`.
    """
    along = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    low, high = np.maximum(along - len(b), 0), np.minimum(along, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        i, j = mid[open_], (along - mid)[open_] - 1
        before = a[i] <= b[j]
        low[open_] = np.where(before, i + 1, low[open_])
        high[open_] = np.where(before, high[open_], i)
    return low, along - low


def merge_piece(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ends of one piece, ascending, the A and the B token that each closes or lies in, and whether
    both end there. `i` and `j` tokens come before the piece."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    ends = both[order]
    from_a = order < len(a)
    first = np.ones(len(ends), bool)
    first[1:] = ends[1:] != ends[:-1]
    at = np.flatnonzero(first)
    shared = np.diff(np.append(at, len(ends))) > 1
    passed_a = np.cumsum(from_a) - from_a  # A ends in the piece before this one
    return ends[at], i + passed_a[at], j + at - passed_a[at], shared


def overlaps(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, A token, B token, whether both end there) for all overlaps of two token sequences over the same
    bytes, given by their ascending ends. Pieces of `size` ends are merged independently."""
    i, j = diagonals(a, b, size)
    pieces = [merge_piece(a[p:q], b[r:s], p, r) for p, q, r, s in zip(i[:-1], i[1:], j[:-1], j[1:])]
    for left, right in zip(pieces[:-1], pieces[1:]):
        if len(left[0]) and len(right[0]) and left[0][-1] == right[0][0]:  # an end of A before, the equal one of B after
            right[1][0], right[2][0], right[3][0] = left[1][-1], left[2][-1], True
    kept = []
    for k, piece in enumerate(pieces):
        n = len(piece[0])
        if n and k + 1 < len(pieces) and len(pieces[k + 1][0]) and pieces[k + 1][0][0] == piece[0][-1]:
            n -= 1
        kept.append([x[:n] for x in piece])
    return tuple(np.concatenate(x) for x in zip(*kept)) if kept else (*[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))


def pack_sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative integers, seven bits each, low ones first, the last byte of each below 128; and
    how many bytes each has."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << (7 * k))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(starts[-1], np.uint8)
    for k in range(int(sizes.max(initial=1))):
        some = sizes > k
        byte = (values[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[starts[:-1][some] + k] = byte + np.where(sizes[some] > k + 1, 128, 0).astype(np.uint64)
    return out, sizes


def unpack_sorted(data: np.ndarray) -> np.ndarray:
    """The integers of `pack_sorted`."""
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], last[:-1] + 1])
    nth = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * nth), starts)


class Groups:
    """Texts of groups, `a1,a2|b1;a3|b2`, from ids in order."""

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b
        numbers = [str(i).encode() for i in range(max(a, b))]
        self.table = [x + e for n, e in ((a, b","), (a, b"|"), (b, b","), (b, b";")) for x in numbers[:n]]

    def __call__(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> list[int]:
        """Entries of the table: of each group the A ids, then the B ids. `a_last` and `b_last` say how many
        tokens end with each group."""
        groups = np.arange(len(a_last))
        a_group, b_group = np.repeat(groups, np.diff(a_last, prepend=0)), np.repeat(groups, np.diff(b_last, prepend=0))
        out = np.empty(len(a) + len(b), np.int64)
        a_text = a.astype(np.int64)
        a_text[a_last - 1] += self.a
        b_text = b.astype(np.int64) + 2 * self.a
        b_text[b_last - 1] += self.b
        out[np.arange(len(a)) + np.append(0, b_last)[a_group]] = a_text
        out[np.arange(len(b)) + a_last[b_group]] = b_text
        return out.tolist()


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "links", "pairs", "holders"]


class Document:
    """What is known of a document while its parts are aligned."""

    def __init__(self):
        self.n = np.zeros(4, np.int64)
        self.hash, self.begun, self.wrong = hashlib.sha256(), False, False

    def add(self, n: np.ndarray, text: bytes) -> None:
        self.n += n
        self.hash.update(b";" + text if self.begun else text)
        self.begun = True


class Block:
    """Documents that share one dictionary of linked pairs."""

    def __init__(self, name: str):
        self.name, self.docs, self.keys, self.times, self.size = name, {}, [], [], 0

    def add(self, doc: np.ndarray, pair: np.ndarray) -> None:
        """Counts links (`doc`, `pair`)."""
        keys, times = np.unique(doc.astype(np.uint64) << np.uint64(32) | pair, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        self.size += len(keys)

    def join(self) -> None:
        if len(self.keys) > 1:
            keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
            times = np.bincount(place, np.concatenate(self.times), len(keys)).astype(np.int64)
            self.keys, self.times, self.size = [keys], [times], len(keys)

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        """A row a document; the first has the dictionary: linked pairs and how many documents hold each."""
        self.join()
        keys = self.keys[0] if self.keys else np.zeros(0, np.uint64)
        times = self.times[0] if self.times else np.zeros(0, np.int64)
        wrong = np.array([d for d, x in self.docs.items() if x.wrong], np.uint64)
        right = ~np.isin(keys >> np.uint64(32), wrong)
        keys, times = keys[right], times[right]
        pairs, place, holders = np.unique(keys & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)
        order = np.argsort(-holders, kind="stable")  # frequent pairs first, so that steps between places are short
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        owner, rank = (keys >> np.uint64(32)).astype(np.int64), rank[place]
        by = np.lexsort((rank, owner))
        owner, rank = np.repeat(owner[by], times[by]), np.repeat(rank[by], times[by])
        numbers = np.array(list(self.docs), np.int64)
        cuts = np.searchsorted(owner, np.append(numbers, 1 << 62))
        steps = np.diff(rank, prepend=0)
        heads = cuts[:-1][cuts[:-1] < cuts[1:]]
        steps[heads] = rank[heads]
        packed, sizes = pack_sorted(steps)
        to = np.concatenate([[0], np.cumsum(sizes)])[cuts].astype(np.int64)
        links = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(numbers), [None, pa.py_buffer(to), pa.py_buffer(packed)])
        docs = list(self.docs.values())
        n = np.array([np.zeros(4, np.int64) if d.wrong else d.n for d in docs]).reshape(-1, 4)
        text = [d.hash.hexdigest() if d.begun and not d.wrong else "" for d in docs]
        rest = [None] * (len(docs) - 1)
        return pa.RecordBatch.from_arrays([
            ids.take(pa.array(numbers)), *[pa.array(n[:, k]) for k in range(4)], pa.array(text), pa.array([self.name] * len(docs)),
            links.cast(pa.binary()),
            pa.array([pairs[order].astype(np.int64), *rest], pa.list_(pa.int64())),
            pa.array([holders[order].astype(np.int64), *rest], pa.list_(pa.int64())),
        ], names=COLUMNS)


def _parts(text: str) -> Iterator[str]:
    """`text`, cut about every STEP characters at a blank between two words; that blank is left out."""
    at = 0
    while len(text) - at > STEP:
        cut = BETWEEN.search(text, at + STEP)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def _aligned(a: str, b: bytes):
    """Arrow function: id and text to COLUMNS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, blocks = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        both = Tokenizers(a, b)
        write = Groups(len(both.a_bytes), len(both.b_bytes))

        def align(block: Block, some: list[tuple[int, str]]) -> None:
            """Adds parts (document, text) to the block."""
            owners, ids = [], []
            for (doc, _), got in zip(some, both([t for _, t in some])):
                if got is None:
                    block.docs[doc].wrong = True
                else:
                    owners.append(doc)
                    ids.append(got)
            if not ids:
                return
            a_ids, b_ids = (np.frombuffer(b"".join([x[k] for x in ids]), np.uint16) for k in (0, 1))
            a_to, b_to = (np.cumsum([len(x[k]) // 2 for x in ids]) for k in (0, 1))
            a_ends, b_ends = np.cumsum(both.a_size[a_ids]), np.cumsum(both.b_size[b_ids])
            ends, a_at, b_at, shared = overlaps(a_ends, b_ends)
            part_ends = a_ends[a_to - 1]
            link_to = np.searchsorted(ends, part_ends, "right")
            a_last, b_last = a_at[shared] + 1, b_at[shared] + 1
            entries = write(a_ids, b_ids, a_last, b_last)
            group_to = np.cumsum(shared)[link_to - 1]
            text_to = (a_to + b_to).tolist()
            counts = np.diff(np.stack([a_to, b_to, group_to, link_to], axis=1), axis=0, prepend=0)
            begin = 0
            for doc, n, end in zip(owners, counts, text_to):
                block.docs[doc].add(n, b"".join(map(write.table.__getitem__, entries[begin:end]))[:-1])
                begin = end
            pair = a_ids[a_at].astype(np.uint64) << np.uint64(16) | b_ids[b_at]
            block.add(np.repeat(np.array(owners), np.diff(link_to, prepend=0)), pair)

        for batch in batches:
            texts = batch.column(1)
            _, rows = flat(texts)
            block, some, held, gathered = Block(f"{task}-{blocks}"), [], 0, 0
            for doc in range(batch.num_rows):
                block.docs[doc] = Document()
                text = texts[doc].as_py() if rows[doc + 1] > rows[doc] else ""
                for part in _parts(text) if text else ():
                    some.append((doc, part))
                    held += len(part)
                    if held >= STEP:
                        align(block, some)
                        some, held = [], 0
                        if block.size - gathered > BLOCK:  # one document of many parts
                            block.join()
                            gathered = block.size
                if block.size >= BLOCK and not some or len(block.docs) >= 5000 or doc == batch.num_rows - 1:
                    align(block, some)
                    yield block.batch(batch.column(0))
                    blocks += 1
                    block, some, held, gathered = Block(f"{task}-{blocks}"), [], 0, 0

    return run


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every row of `docs`, written to the shared folder: doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, and for `count_links` the block, the links as places in its dictionary and, in one row of
    each block, that dictionary: linked pairs (A id * 65536 + B id) and how many documents of the block hold them.
    """
    with open(a_path, encoding="utf-8") as f:
        a = f.read()
    with open(b_path, "rb") as f:
        b = f.read()
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in COLUMNS[1:5]],
        T.StructField("groups_sha256", T.StringType()), T.StructField("block", T.StringType()), T.StructField("links", T.BinaryType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("holders", T.ArrayType(T.LongType())),
    ])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialise(texts.mapInArrow(_aligned(a, b), schema), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best) of all linked pairs: how many documents hold each, and whether that is the highest
    count of its A id. The counts of a block's documents come summed from its task."""
    entries = aligned.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holders")).alias("e"))
    counts = entries.groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.holders").alias("docs"))
    highest = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 16)))
    return counts.select("pair", "docs", (F.col("docs") == highest).alias("best"))


def _summed(ids: T.DataType):
    """Cogroup function: documents of a block, and its dictionary's counts, to the documents with their sums."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        docs, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = right["place"].to_numpy()
        docs[place], best[place] = right["docs"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        data, rows = flat(left["links"].cast(pa.large_binary()))
        steps = unpack_sorted(data)
        cuts = np.concatenate([[0], np.cumsum(data < 128)])[rows]  # integers before each row
        total = np.concatenate([[0], np.cumsum(steps)])
        starts = np.repeat(total[cuts[:-1]], np.diff(cuts))
        at = total[1:] - starts
        sums = [np.concatenate([[0], np.cumsum(x[at] if size else at)])[cuts] for x in (best, docs)]
        out = left.drop_columns(["block", "links"])
        for name, x in zip(("n_best", "count_sum"), sums):
            out = out.append_column(name, pa.array(np.diff(x), pa.int64()))
        return out

    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the tokens of two tokenizers lie over each other, for every row of `docs`.

    A is a byte-level tokenizer's file, applied to a blank and the text, B a sentencepiece model, applied to
    the text; special tokens are neither added nor recognised. Returns doc_id, n_a, n_b (tokens), n_groups (parts
    between ends that both have), n_links (overlaps of an A and a B token), groups_sha256, n_best (links whose
    pair of ids is in as many documents as any pair of its A id) and count_sum (over links, the documents that
    hold the pair). Null and empty texts, and those that B does not spell byte for byte, have no tokens:
    zeros and an empty groups_sha256. Rows that repeat an id are documents of their own, and equal rows count
    each; null ids are kept; other columns are ignored.
    """
    aligned = alignments(docs, a_path, b_path, id_col, text_col)
    entries = aligned.where("pairs is not null").select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    back = entries.join(pair_counts(aligned), "pair").select("of", "place", "docs", "best")
    rows = aligned.drop("pairs", "holders")
    kept = [f for f in rows.schema if f.name not in ("block", "links")]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_summed(rows.schema["doc_id"].dataType), schema)

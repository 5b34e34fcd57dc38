"""Packing of token sequences by cutting-stock column generation over a histogram of lengths."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.ranks import ranked
from panelmill.llm.scan import flat, slices
from panelmill.session import materialise

SEQUENCE = 2048
END = 1
#: Tokens per step of the histogram; a piece takes whole steps when patterns are chosen.
UNIT = 4
#: Words whose ids a task remembers before it forgets those that it has not met since the last time.
REMEMBERED = 500_000
#: Bytes of text whose ids a task holds at once.
SLICE = 1 << 20
#: Words encoded in one call, and punctuation that may end a word (no apostrophe).
TOGETHER = 200
ENDS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: Words of letters below this one are encoded by ranks; all of them have the same lower case in every library.
RANKED_BELOW = "\u0250"


def _ends_in_letter(text: str) -> bool:
    """Whether the last character is a letter once it is composed and lower-cased."""
    return unicodedata.normalize("NFC", text)[-1].lower()[-1].isalpha()


class Ranks:
    """Ids of words of lower-case letters, from the merges of the tokenizer as ranks of byte strings.

    A word is its bytes and a zero that marks its end, so "</w>" is a byte too; a last byte and the zero
    merge first. Of two neighbours the pair of least rank merges, as in the tokenizer, whose library is
    several times slower on single words. `ids` are little-endian unsigned 32-bit integers.
    """

    def __init__(self, model: dict):
        from tiktoken import Encoding

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        self.byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        merges = [self._bytes("".join(pair)) for pair in model["merges"]]
        order = [bytes([b, 0]) for b in range(256)] + merges + [bytes([b]) for b in range(256)]
        ranks = {token: i for i, token in enumerate(order)}
        ids = {self._bytes(token): i for token, i in model["vocab"].items()}
        self.ids = np.array([ids[token] for token in order], np.uint32)
        self.closes = np.array([len(token) > 1 and token[-1] == 0 for token in order])
        self.encoding = Encoding("by-rank", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})

    def _bytes(self, token: str) -> bytes:
        stem = token.removesuffix("</w>")
        return bytes(map(self.byte.__getitem__, stem)) + b"\0" * (stem != token)

    def __call__(self, words: list[str]) -> list[bytes]:
        found = np.array(self.encoding.encode_ordinary("\0".join(words) + "\0"), np.int64)
        cuts = (4 * np.flatnonzero(self.closes[found]) + 4).tolist()
        data = self.ids[found].tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    @classmethod
    def of(cls, spec: str) -> Ranks | None:
        """Those of a tokenizer file; None where the file is not byte pairs with "</w>" at word ends."""
        model = json.loads(spec)["model"]
        known = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>"
        known = known and len({"".join(pair) for pair in model["merges"]}) == len(model["merges"])  # one way to each token
        if not known or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
            return None
        try:
            return cls(model)
        except KeyError:  # not an alphabet of bytes
            return None


class WordTokens:
    """Ids of whole texts from ids of their words.

    The tokenizer drops white space and never merges over it, so ids of a text are those of its
    words in turn. It also splits between a letter and punctuation and lower-cases, so a word that
    ends in punctuation has the ids of its stem and of its end, where the stem still ends in a letter
    when it is normalised: some letters become a letter and a mark, which goes with the punctuation.
    New stems of Latin letters alone go through `Ranks`, all others through the tokenizer, together.
    """

    def __init__(self, tokenizer, ranks: Ranks | None = None):
        self.tokenizer, self.ranks, self.known, self.old = tokenizer, ranks, {b"": b""}, {}

    def _encode(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        places = np.cumsum([0] + [len(t) + 1 for t in texts])
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        owner = np.searchsorted(places, np.array([a for a, _ in found.offsets], np.int64), "right") - 1
        cuts = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        data = ids.tobytes()
        self.known.update(zip(words, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]))

    def _by_rank(self, words: list[bytes]) -> list[bytes]:
        """Learns the words of Latin letters and returns the others."""
        ranked, letters, others = [], [], []
        for w in words:
            if not w.isascii():
                text = unicodedata.normalize("NFC", w.decode()).lower()
                latin = text.isalpha() and max(text) < RANKED_BELOW
            elif latin := w.isalpha():
                text = w.decode().lower()
            if latin:
                ranked.append(w)
                letters.append(text)
            else:
                others.append(w)
        if ranked:
            self.known.update(zip(ranked, self.ranks(letters)))
        return others

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, bytes]:
        """Stem and punctuation at the end; the stem ends in a letter, or is the whole word."""
        if word.isalpha():  # of ASCII letters
            return word.lower(), b""
        if b"<|" in word:
            return word, b""
        stem = word.rstrip(ENDS)
        if not stem or len(stem) < len(word) and not (
            stem[-1:].isalpha() or stem[-1] > 127 and _ends_in_letter(stem.decode())
        ):
            stem = word
        return (stem.lower() if stem.isascii() else stem), word[len(stem):]

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {b"": b""}
        known = self.known
        new = {w for w in words if w not in known}  # `-` would walk through all known words
        if self.old:
            met = new & self.old.keys()
            known.update((w, self.old[w]) for w in met)
            new -= met
        parts = {w: self._parts(w) for w in new}
        stems = {p for both in parts.values() for p in both if p not in known}
        if self.old:
            met = stems & self.old.keys()
            known.update((w, self.old[w]) for w in met)
            stems -= met
        stems = self._by_rank(list(stems)) if self.ranks else list(stems)
        for at in range(0, len(stems), TOGETHER):
            self._encode(stems[at:at + TOGETHER])
        for w, (stem, end) in parts.items():
            if end or stem != w:
                known[w] = known[stem] + known[end]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def _pieces(tokenizer: str):
    """Arrow function: id and text to the pieces of the text's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encode = WordTokens(Tokenizer.from_str(tokenizer), Ranks.of(tokenizer))
        end = np.array([END], np.uint32).tobytes()
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            data, rows = flat(batch.column(1))
            owner, start, total, ids = [], [], [], []
            for i, whole in enumerate(encode([data[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])])):
                whole += end
                for a in range(0, len(whole), 4 * SEQUENCE):
                    owner.append(i)
                    start.append(a // 4)
                    total.append(len(whole) // 4)
                    ids.append(whole[a:a + 4 * SEQUENCE])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()),
                pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary()),
            ], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every row, cut after each 2048: doc_id, start, length, doc_tokens, ids, ids_crc32.

    A row's ids end with END, so a null or empty text has one. `ids` are little-endian unsigned 32-bit
    integers. Rows that repeat an id are documents of their own.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_pieces(tokenizer), schema).withColumn("ids_crc32", F.crc32("ids"))


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[np.ndarray, float]:
    """The multiset of ascending `sizes` within `room` that is worth most (unbounded knapsack)."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        value[c] = value[c - 1]
        if fits[c]:
            got = worth[:fits[c]] + value[c - sizes[:fits[c]]]
            best = int(np.argmax(got))
            if got[best] > value[c] + 1e-12:
                value[c], choice[c] = got[best], best
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return pattern, value[room]


def _greedy(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """A pattern filled from the largest size down, of what is left."""
    pattern, free = np.zeros(len(sizes), np.int64), room
    for i in np.flatnonzero(left)[::-1]:
        pattern[i] = min(left[i], free // sizes[i])
        free -= pattern[i] * sizes[i]
    return pattern


def _first_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """Greedy patterns, each used (in fractions) until a size runs out: a triangular, feasible basis."""
    left, columns = demand.astype(float), []
    while (left > 0).any():
        pattern = _greedy(sizes, np.ceil(left).astype(np.int64), room)
        used = pattern > 0
        ratio = np.where(used, left / np.where(used, pattern, 1), np.inf)
        out = int(np.argmin(ratio))
        after = np.maximum(left - ratio[out] * pattern, 0)
        after[out] = 0
        columns.append(pattern)
        for i in np.flatnonzero((left > 0) & (after <= 1e-9)):  # ran out with it: a column of its own, not used
            after[i] = 0
            if i != out:
                columns.append(np.where(np.arange(len(sizes)) == i, room // sizes, 0))
        left = after
    return np.stack(columns, axis=1)


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns of ascending `sizes` and how often each is used; together they hold the demand exactly.

    Solves the linear relaxation by column generation until it is within `gap` of a lower bound (that
    of the prices, or no waste at all), rounds the uses down and fills what is left from the largest
    size down. The work depends on the number of sizes, not on the demand.
    """
    m = len(sizes)
    if m == 0:
        return []
    basis = _first_basis(sizes, demand, room)
    inverse = np.linalg.inv(basis.astype(float))
    no_waste = (sizes * demand).sum() / room
    steps = 0
    while True:
        used = np.maximum(inverse @ demand, 0)
        if used.sum() <= (1 + gap) * no_waste:
            break
        column, value = _best_pattern(sizes, np.maximum(inverse.sum(axis=0), 0), room)
        if value <= 1 + gap:
            break
        turn = inverse @ column
        ratio = np.where(turn > 1e-9, used / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        steps += 1
        if steps % 100 == 0:
            inverse = np.linalg.inv(basis.astype(float))
        else:
            row = inverse[out] / turn[out]
            inverse -= np.outer(turn, row)
            inverse[out] = row
    times = np.floor(np.maximum(np.linalg.solve(basis.astype(float), demand.astype(float)), 0) + 1e-7).astype(np.int64)
    left = demand - basis @ times
    for i in np.flatnonzero(left < 0):  # a use rounded up by the tolerance
        for p in np.flatnonzero(basis[i] * times):
            while left[i] < 0 and times[p]:
                times[p] -= 1
                left += basis[:, p]
    out = [(basis[:, p].copy(), int(times[p])) for p in range(m) if times[p]]
    while left.any():
        pattern = _greedy(sizes, left, room)
        uses = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, uses))
        left = left - uses * pattern
    return out


PLACES = "step long, low long, high long, first_sequence long, per_sequence long, first_slot long"


def _places(chosen: list[tuple[np.ndarray, int]], sizes: np.ndarray) -> list[tuple[int, ...]]:
    """Which ranks of each size go where: rows of PLACES. As many as the patterns have entries."""
    rows, sequence, taken = [], 0, {}
    for pattern, uses in chosen:
        slot = 0
        for i in np.flatnonzero(pattern):
            size, each = int(sizes[i]), int(pattern[i])
            low = taken.get(size, 0)
            taken[size] = low + each * uses
            rows.append((size, low, taken[size], sequence, each, slot))
            slot += each
        sequence += uses
    return rows


def layout(cut: DataFrame, order: list[str]) -> DataFrame:
    """`cut` (rows with `length` up to SEQUENCE) with sequence_id and offset.

    `cut` has to be a stored table, as it is read twice. Only the histogram of lengths (512 steps) and
    the chosen patterns pass through the driver. Pieces of one length are ranked pseudo-randomly by
    `order`, and each range of ranks belongs to one slot of a pattern.
    """
    spark = cut.sparkSession
    cut = cut.withColumn("step", F.ceil(F.col("length") / UNIT))
    counts = dict(cut.groupBy("step").count().collect())
    room = SEQUENCE // UNIT
    sizes = np.array(sorted(s for s in counts if s < room), np.int64)
    chosen = patterns(sizes, np.array([counts[s] for s in sizes], np.int64), room)
    if room in counts:
        sizes = np.append(sizes, room)
        chosen = [(np.append(p, 0), n) for p, n in chosen]
        chosen.append((np.eye(len(sizes), dtype=np.int64)[-1], counts[room]))
    places = F.broadcast(spark.createDataFrame(_places(chosen, sizes), PLACES))
    rows = ranked(cut, ["step"], order, "rank")
    rows = rows.join(places, "step").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    rows = rows.withColumns({
        "sequence_id": F.col("first_sequence") + F.floor(nth / F.col("per_sequence")),
        "slot": F.col("first_slot") + nth % F.col("per_sequence"),
    })
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return rows.select(*[c for c in cut.columns if c != "step"], "sequence_id", offset)


def pack(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of `docs` as pieces of sequences of at most 2048 tokens.

    Texts are cut after each 2048 ids; whole sequences stand alone, and the rest of each text stays in
    one piece. Returns `pieces` with sequence_id and offset; `keep_ids` says whether with the ids.
    """
    cut = pieces(docs, tokenizer_path, id_col, text_col)
    cut = materialise(cut if keep_ids else cut.drop("ids"), "pieces")
    return layout(cut, ["doc_id", "start", "doc_tokens", "ids_crc32"])

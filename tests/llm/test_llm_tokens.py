"""Token counts, alignment and hard negatives against brute force, also through their registered queries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from panelmill.llm import alignment, catalog, negatives, token_counts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block string, n_a int, pair long, links string, n_tokens int, keys string"
CLASH = ("b", 1, 2, "l", 3, "k")


def _texts():
    draw = random.Random(13)
    odd = ["".join(draw.choice("ab \n\té.{};0 'sé日▁") for _ in range(draw.randint(0, 40))) for _ in range(800)]
    return [
        None, "", " ", "  ", "\n", "\n\n x", " \n", "a▁ b", "▁", " ▁", "a  b   c    ", "\t\ta\r\n b", "x" * 300 + " y", "tie", "tie",
        "a<|endoftext|>b <s> </s>", "日本語" * 400, "word " * 3000, " ".join(f"long{i}" for i in range(140_000)), "é" * 90_000, *odd,
    ]


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    out = [(i, t, *CLASH) for i, t in enumerate(texts)]
    return out + out[5:15] + [(None, texts[12], *CLASH), (None, None, *CLASH), (3, texts[12], *CLASH)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def spell():
    """Ids and their bytes by the libraries alone."""
    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    both = alignment.Tokenizers(open(BYTES, encoding="utf-8").read(), open(PIECES, "rb").read())
    return lambda text: ((a.encode(" " + text, add_special_tokens=False).ids, both.a_bytes), (b.encode(text), both.b_bytes))


def _align(text, spell):
    """(n_a, n_b, n_groups, n_links, groups) and the links of one text."""
    nothing = (0, 0, 0, 0, ""), Counter()
    if not text:
        return nothing
    sides = []
    for ids, table in spell(text):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return nothing
        ends = np.cumsum([len(table[i]) for i in ids])
        sides.append((ids, [0, *ends[:-1]], list(ends)))
    (a, a_from, a_to), (b, b_from, b_to) = sides
    links, first = Counter(), 0
    for i, s, e in zip(a, a_from, a_to):
        while b_to[first] <= s:
            first += 1
        j = first
        while j < len(b) and b_from[j] < e:
            links[(i, b[j])] += 1
            j += 1
    groups, x, y = [], 0, 0
    for end in sorted(set(a_to) & set(b_to)):
        p, q = x, y
        while x < len(a) and a_to[x] <= end:
            x += 1
        while y < len(b) and b_to[y] <= end:
            y += 1
        groups.append(",".join(map(str, a[p:x])) + "|" + ",".join(map(str, b[q:y])))
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
    return (len(a), len(b), len(groups), sum(links.values()), digest), links


def _check_alignment(found, rows, spell):
    each = [(i, *_align(t, spell)) for i, t in rows]
    docs = Counter(pair for _, _, links in each for pair in links)
    highest = Counter()
    for (a, _), n in docs.items():
        highest[a] = max(highest[a], n)
    want = Counter(
        (i, *sums, sum(n for pair, n in links.items() if docs[pair] == highest[pair[0]]), sum(n * docs[pair] for pair, n in links.items()))
        for i, sums, links in each
    )
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert Counter(tuple(r[n] for n in names) for r in found) == want


def test_alignment(docs, rows, spell):
    _check_alignment(alignment.align(docs, BYTES, PIECES).collect(), [r[:2] for r in rows], spell)


def test_alignment_query(spark, tmp_path, spell):
    rows = [(i, t) for i, t in enumerate(_texts()[:60])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    _check_alignment(catalog.QUERIES["op13_alignment"](spark, str(tmp_path)).collect(), rows, spell)


def test_alignment_empty(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), BYTES, PIECES).collect() == []
    only = spark.createDataFrame([(1, None, *CLASH)], SCHEMA)
    row = alignment.align(only, BYTES, PIECES).first()
    assert (row.n_a, row.n_best, row.count_sum, row.groups_sha256) == (0, 0, 0, "")


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 16])
def test_merge_pieces(size):
    draw = np.random.default_rng(size)
    for _ in range(50):
        total = int(draw.integers(1, 60))
        a, b = (np.unique(np.append(draw.integers(1, total + 1, int(draw.integers(0, 40))), total)) for _ in range(2))
        ends, i, j, shared = alignment.overlaps(a, b, size)
        want = np.union1d(a, b)
        assert (ends == want).all() and (shared == (np.isin(want, a) & np.isin(want, b))).all()
        assert (i == np.searchsorted(a, want)).all() and (j == np.searchsorted(b, want)).all()
        p, q = alignment.diagonals(a, b, size)
        assert (np.diff(p + q)[:-1] == size).all() and p[-1] == len(a) and q[-1] == len(b)


def test_packed_integers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 0])
    assert (alignment.unpack_sorted(alignment.pack_sorted(values)[0]) == values).all()


def test_ranks_encode_every_character_as_the_file_does():
    both = alignment.Tokenizers(open(BYTES, encoding="utf-8").read(), open(PIECES, "rb").read())
    texts = [f"x{c}y1{c}1 {c} .{c}.  {c}{c}'s" for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000]
    for text, found in zip(texts, both.a.encode_batch(texts, add_special_tokens=False)):
        assert both.ranks.encode_ordinary(text) == found.ids


def test_token_counts(docs, rows):
    model = SentencePieceProcessor(model_file=PIECES)
    want = Counter((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or "")), len(model.encode(r[1] or "")) > 4096) for r in rows)
    assert Counter(map(tuple, token_counts.count_tokens(docs, PIECES).collect())) == want
    nothing = token_counts.Table(np.zeros(0, np.uint64), np.zeros(0, np.uint16))
    assert Counter(map(tuple, token_counts.count_tokens(docs, PIECES, table=nothing).collect())) == want


def test_token_counts_query(spark, tmp_path):
    model = SentencePieceProcessor(model_file=PIECES)
    rows = [(i, t) for i, t in enumerate(_texts()[:40])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["op12_token_counts"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.n_tokens) for r in found} == {(i, len(model.encode(t or ""))) for i, t in rows}
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), PIECES).collect() == []


def test_forgetful_cache(monkeypatch):
    """Results do not depend on what a worker remembers or where it cuts a text."""
    monkeypatch.setattr(token_counts, "CACHED", 3)
    monkeypatch.setattr(token_counts, "STEP", 64)
    model = SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in _texts()[:400] if t is None or len(t) < 20_000]

    class Shared:
        value = token_counts.Table(np.zeros(0, np.uint64), np.zeros(0, np.uint16))

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    found = list(token_counts._counted(open(PIECES, "rb").read(), Shared)(iter([batch])))
    assert found[0].column(2).to_pylist() == [len(model.encode(t or "")) for t in texts]


def test_frequent_pretokens(spark):
    """A pre-token that makes up more than one in `size` of all is in the table, however it is spread."""
    texts = [(f"common w{i} rare{i}",) for i in range(3000)]
    docs = spark.createDataFrame(texts, "text string").repartition(40)
    table = token_counts.frequent(docs, PIECES, size=16)
    pieces = token_counts.Pieces(open(PIECES, "rb").read())
    data = np.frombuffer(b"common", np.uint8)
    found, _ = token_counts.Splitter(pieces.barriers)(data, np.array([0, 6]), np.array([True]))
    assert table(found.keys).tolist() == pieces.lengths([b" common"])


def _negatives(rows, every=100):
    sound = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    q = [np.floor(256 * np.array(r[1], np.float32).astype(float)).astype(np.int64) for r in sound]
    out = Counter()
    for a, row in enumerate(sound):
        if row[0] % every:
            continue
        scores = sorted((-int(q[a] @ q[b]), sound[b][0], b) for b in range(len(sound)) if b != a and len(q[a]) == len(q[b]))
        for p, pid, _ in [s for s in scores if sound[s[2]][2] == row[2]][:5]:
            fits = [s for s in scores if sound[s[2]][2] != row[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out.update((row[0], pid, k + 1, nid, -p, -n) for k, (n, nid, _) in enumerate(fits))
    return out


VECTORS = "vec_id long, embedding array<float>, label int, id string, block string, key int, score string, area int"


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        x = draw.normal(size=16) / 4
        x = rows[i - 40][1] if i % 9 == 8 and i > 40 else [float(v) for v in x]  # copies
        rows.append((i, x, int(draw.integers(0, 4)), "c", "c", 0, "c", 0))
    odd = [None, [], [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [0.5, -0.5], [0.0] * 16]
    rows += [(1500 + 100 * i, x, 1, "c", "c", 0, "c", 0) for i, x in enumerate(odd)]
    rows += [(2300, [0.25, 1.0], 2, "c", "c", 0, "c", 0), (None, rows[0][1], 1, "c", "c", 0, "c", 0), (2400, rows[5][1], None, "c", "c", 0, "c", 0)]
    return rows


@pytest.mark.parametrize("sizes", [(512, 64, 2048), (16, 2, 4)])
def test_negatives(spark, vectors, sizes, monkeypatch):
    for name, size in zip(("BLOCK", "AREA", "CREW"), sizes):
        monkeypatch.setattr(negatives, name, size)
    found = negatives.hard_negatives(spark.createDataFrame(vectors, VECTORS).repartition(6))
    assert Counter(map(tuple, found.collect())) == _negatives(vectors)


def test_negatives_repeated_and_empty(spark, vectors):
    again = vectors[:300] + vectors[100:140]
    found = negatives.hard_negatives(spark.createDataFrame(again, VECTORS).repartition(3))
    assert Counter(map(tuple, found.collect())) == _negatives(again)
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []


def test_zone_bounds_hold():
    draw = np.random.default_rng(1)
    block, anchors = draw.integers(-200, 200, (50, 8)), draw.integers(-200, 200, (20, 8))
    low, high = negatives._bounds(anchors, block.min(axis=0), block.max(axis=0))
    scores = anchors @ block.T
    assert (low <= scores.min(axis=1)).all() and (high >= scores.max(axis=1)).all()


def test_hilbert_order():
    """Rows of different cells have different keys; equal rows and scaled ones share theirs."""
    steps = [-3.0, -1.0, 1.0, 3.0]
    rows = np.array([[x, y, *steps, *steps, *steps] for x in steps for y in steps])
    keys = negatives.hilbert_keys(rows)
    assert len(set(keys)) == 16 and negatives.hilbert_keys(rows * 5) == keys

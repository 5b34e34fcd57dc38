"""Which pairs of near deduplication are compared, and that none with a link is left out."""

from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from panelmill.llm import components, neardup, packing
from panelmill.session import materialise


def _shingles(text):
    words = text.lower().split()
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)}


def _components(texts):
    sets = {i: _shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sets, 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def _classes(docs):
    sets = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(neardup._sets(neardup.K), neardup._schema(docs.schema["doc_id"].dataType))
    return sets.select(F.col("id").alias("node"), "n", F.col("hashes").alias("sketch"))


def test_one_common_value_makes_no_star(spark):
    """Texts of like sizes that have one rare word pair in common, and nothing else."""
    texts = [(i, " ".join(["rare phrase", *(f"w{i}x{j}" for j in range(30 + i % 5))])) for i in range(60)]
    texts += [(100, texts[0][1] + " more"), (101, texts[0][1] + " words")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    stars = {(r.a, r.b) for r in neardup._stars(neardup._index(_classes(docs))).collect()}
    assert stars <= {(0, 100), (0, 101), (100, 101)} and stars
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == _components(texts)


def test_families_around_the_limit(spark):
    """Copies with edits, of whole and of sampled sets, get the components of all pairs."""
    rng = np.random.default_rng(11)
    texts = []
    for size in (6, 40, 120, 260):
        for family in range(3):
            words = [f"f{size}_{family}_{k}" for k in range(size)]
            for _ in range(8):
                edited = list(words)
                for place in rng.integers(0, size, rng.integers(0, max(2, size // 10))):
                    edited[place] = f"e{rng.integers(10**9)}"
                texts.append((len(texts), " ".join(edited)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == _components(texts)


def test_pairs_carry_halves_of_values(spark):
    """Values of a set that have one high half lose no link of whole sets."""
    values = [(k << 32) + 5 for k in range(10)]
    a, b = [*values[:9], values[8] + 1], [*values[:9], values[8] + 1, values[9]]
    classes = spark.createDataFrame([(1, 10, a), (2, 11, b)], "node long, n long, sketch array<long>")
    found = neardup._estimated(spark.createDataFrame([(1, 2)], "a long, b long"), classes)
    assert [tuple(r) for r in found.collect()] == [(1, 2, True)]
    assert "array<int>" in found._jdf.queryExecution().analyzed().treeString() or "as int" in found._jdf.queryExecution().analyzed().toString()


def test_short_values_leave_no_link_out(spark):
    """Sets of which many values agree in their high 16 bits: what the short comparison keeps holds every link."""
    draw = np.random.default_rng(4)
    pool = (draw.integers(-3, 3, 60) << 48) + draw.integers(0, 1 << 40, 60)
    sets = [sorted({int(v) for v in draw.choice(pool, draw.integers(1, 60))}) for _ in range(20)]
    sets += [sorted({*s, 1 << 50}) for s in sets]
    far = [sorted(int(v) for v in draw.integers(-(1 << 62), 1 << 62, 50)) for _ in range(4)]
    full = spark.createDataFrame(list(enumerate(sets + far)), "node long, hashes array<long>")
    pairs = [(a, b) for a in range(len(sets + far)) for b in range(a + 1, len(sets + far))]
    listed = spark.createDataFrame(pairs, "a long, b long")
    kept = {(r.a, r.b) for r in neardup._possible(listed, full).collect()}
    both = [(set((sets + far)[a]), set((sets + far)[b])) for a, b in pairs]
    linked = {p for p, (x, y) in zip(pairs, both, strict=True) if 100 * len(x & y) >= 80 * len(x | y)}
    assert linked and linked <= kept
    assert not {p for p in kept if p[1] >= len(sets)}
    assert {(r.a, r.b) for r in neardup._verified(listed, full).collect()} == linked


def test_plans_stay_small(spark, monkeypatch):
    """No step of near deduplication holds the steps before it again: their plans are what the driver's memory goes to."""
    texts = [(i, " ".join(f"f{i % 7}_{k}" for k in range(30)) + f" own{i}") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sizes = {}

    def watched(df, name, *rest):
        sizes[name] = max(sizes.get(name, 0), len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return materialise(df, name, *rest)

    for module in (neardup, components):
        monkeypatch.setattr(module, "materialise", watched)
    found = neardup.near_duplicates(docs)
    assert {r.doc_id: r.component_id for r in found.collect()} == _components(texts)
    assert max(sizes.values()) <= 60, sizes


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Links that already lead to the smallest node are joined with nothing; others end right."""
    joins = []

    def watched(df, name, *rest):
        joins.append("Join" in df._jdf.queryExecution().optimizedPlan().toString())
        return materialise(df, name, *rest)

    monkeypatch.setattr(components, "materialise", watched)
    star = spark.createDataFrame([(1, 2), (3, 1), (5, 9), (9, 5), (4, 4)], "a long, b long")
    assert {tuple(r) for r in components.components(star).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (9, 5)}
    assert joins and not any(joins)
    line = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(60, 50), (60, 55)], "a long, b long")
    expected = {(i, 1) for i in range(1, 41)} | {(50, 50), (55, 50), (60, 50)}
    assert {tuple(r) for r in components.components(line).collect()} == expected
    assert components.components(line.where("false")).collect() == []


def test_texts_are_worked_off_by_bytes(monkeypatch):
    """However many rows a batch has, sets and tokens are made of a slice of its texts at a time, and of all of them."""
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    texts = [f"row {i} " * 50 for i in range(300)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(302)), pa.array(texts)], names=["id", "text"])
    for module, run, name in ((neardup, neardup._sets(neardup.K), "id"), (packing, packing._pieces(spec), "doc_id")):
        monkeypatch.setattr(module, "SLICE", 4000, raising=False)
        out = list(run(iter([batch])))
        assert [i for part in out for i in part.column(name).to_pylist()] == list(range(302))
        assert max(part.num_rows for part in out) <= 12

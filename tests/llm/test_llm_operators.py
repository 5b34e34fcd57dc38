"""Every operator on a small table with odd rows, against a brute-force version."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelmill.llm import exact, fingerprints, fuse, langid, licenses, mixing, neardup, packing, quality, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n string, row string, size int"
BASE = [f"w{i}" for i in range(120)]
PATH = public_tokenizers.path("word_bpe_49k.json")


def _texts():
    near = [" ".join(BASE[:k] + [f"x{k}"] + BASE[k + 1:]) for k in range(0, 60, 10)]
    passage = " ".join(f"p{i}" for i in range(50))
    return [
        None, "", " \n\t ", "one", "ONE", "One", "two words", *near, " ".join(BASE), " ".join(BASE).upper(),
        f"own a {passage} own b", f"other {passage}", "Straße É é İ   x", "a\u0085b c",
        "rep " * 400, "Released under the MIT License.\nmore", "long " + " ".join(f"q{i % 5000}" for i in range(60000)),
        "1234 !! ??", passage, "tie", "tie",
    ]


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    langs = ["en", "fr", None]
    out = [(i, t, langs[i % 3], None if i % 7 == 3 else f"s{i % 4}", None, "clash", None, "r", i) for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Also null and repeated ids, and repeated rows."""
    return spark.createDataFrame(rows + rows[3:9] + [(None, *rows[9][1:]), (None, *rows[4][1:]), (5, *rows[10][1:])], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _lower(text):
    return (text or "").encode().lower()


def _shingles(text):
    w = _lower(text).split()
    return {b" ".join(w[i:i + 2]) for i in range(len(w) - 1)} or ({w[0]} if w else set())


def test_fuse_has_no_false_negative():
    for n in (0, 1, 2, 7, 300, 20000):
        keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        made = fuse.build(keys)
        assert fuse.contains(made, keys).all()
        others = np.random.default_rng(n + 1).integers(0, 2**63, 5000).astype(np.uint64)
        assert fuse.contains(made, others).mean() < 0.02


def test_exact(docs, odd, empty, rows):
    for old in (F.col("doc_id") % 2 == 0, F.lit(False), F.lit(None).cast("boolean")):
        got = {r["doc_id"]: r for r in exact.exact_duplicates(docs, old).collect()}
        groups = {}
        for r in rows:
            groups.setdefault(_lower(r[1]), []).append(r[0])
        for text, ids in groups.items():
            for i in ids:
                r = got[i]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
                assert bytes(r["digest"]) == hashlib.sha256(text).digest()
    kept = exact.keep_rows(odd, exact.exact_duplicates(odd, F.col("doc_id") % 2 == 0))
    assert kept.columns == odd.columns
    texts = [_lower(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({_lower(r["text"]) for r in odd.collect()})
    assert exact.exact_duplicates(empty, F.lit(True)).count() == 0


def test_neardup(docs, odd, empty, rows):
    sets = {r[0]: _shingles(r[1]) for r in rows}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 80 * len(x | y) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    got = neardup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == group
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    found = neardup.near_duplicates(odd)
    assert found.count() == odd.count()
    kept = neardup.keep_rows(odd, found).collect()
    for a in kept:
        x = _shingles(a["text"])
        assert sum(1 for b in kept if x and 100 * len(x & _shingles(b["text"])) >= 80 * len(x | _shingles(b["text"]))) <= 1
    assert neardup.near_duplicates(empty).count() == 0


def test_substrings(docs, odd, empty, rows):
    words = {r[0]: (r[1] or "").encode().split() for r in rows}
    seen = Counter(tuple(w[i:i + 35]) for w in words.values() for i in range(len(w) - 34))
    for r in substrings.remove_repeats(docs).collect():
        w = words[r["doc_id"]]
        covered = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                covered |= set(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in covered).decode()
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), len(covered), kept)
    assert substrings.remove_repeats(odd).count() == odd.count()
    assert substrings.remove_repeats(empty).count() == 0


def test_packing_round_trip(docs, odd, empty, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH).collect()
    for r in rows:
        mine = sorted((p for p in got if p["doc_id"] == r[0]), key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in mine), "<u4").tolist()
        assert ids == tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) for p in mine)
    sequences = {}
    for p in got:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len({p["doc_id"] for p in packing.pack(odd, PATH, False).collect()}) == len({r["doc_id"] for r in odd.collect()})
    assert packing.pack(empty, PATH).count() == 0


def test_patterns_hold_the_demand():
    draw = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.sort(draw.choice(np.arange(1, 513), 40, replace=False))
        demand = draw.integers(1, 400, 40)
        chosen = packing.patterns(sizes, demand, 512)
        assert (sum(p * n for p, n in chosen) == demand).all()
        assert all((p * sizes).sum() <= 512 for p, _ in chosen)


def test_mixing(docs, odd, empty, rows):
    got = mixing.mix(docs).collect()
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(total.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * total[s]}
        if not above:
            break
        for s in above:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= above
    target |= share
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert len(r["shards"]) == (r["copies"] if r["size"] else 0)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    clash = docs.withColumns({c: F.lit(c) for c in ("shard", "place", "of", "copy", "shards", "_shard")})
    rows_out = mixing.mixed(clash, mixing.mix(clash))
    assert rows_out.count() == sum(r["copies"] for r in got)
    assert rows_out.columns == [*clash.columns, "__shard", "_place"] and rows_out.first()["shard"] == "shard"
    assert mixing.mix(odd).agg(F.sum("size")).first()[0] == sum(len((r["text"] or "").encode().split()) for r in odd.collect())
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("sizes", [
    {"a": [30] * 40, "b": [10] * 10, "c": [900]},
    {"a": [5] * 30, "b": [700], "c": [60] * 9 + [1], None: [4000, 3, 9]},
    {"a": [7, 5000, 11, 13] * 3, "b": [100, 100, 6000], "c": [1]},
])
def test_mixing_comes_near_the_targets(spark, sizes):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, all_of in sizes.items() for n in all_of)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(len(r["shards"]) == r["copies"] for r in got)
    for source, all_of in sizes.items():
        mine = [r for r in got if r["source"] == source]
        target, taken = mine[0]["target"], sum(r["taken"] for r in mine)
        epochs = target // sum(all_of)
        assert all(epochs <= r["copies"] <= epochs + 1 for r in mine)
        if len(all_of) == 1:
            assert abs(taken - target) == min(abs(k * all_of[0] - target) for k in range(3))
        for r in mine:
            more = r["size"] if r["copies"] == epochs and target < 2 * sum(all_of) else 0
            assert abs(taken - target) <= abs(taken + more - target), (source, taken, target, more)


def _shares(ends):
    return np.diff([0, *ends])


def test_shards_of_the_tree_are_even(spark):
    draws = {i: d for i, d in enumerate([100, 0, 1, 349, 7, 5_000_000_000] + [3] * 600, 1)}
    quotas = spark.createDataFrame(list(draws.items()), "place long, draws long")
    got = {r["place"]: _shares(r["ends"]) for r in mixing._dealt(quotas, 8).collect()}
    assert {p: s.sum() for p, s in got.items()} == draws and min(s.min() for s in got.values()) >= 0
    leaves = sum(got.values())
    assert len(leaves) == 8 and leaves.max() - leaves.min() <= 1


def test_shares_follow_the_hypergeometric_law(spark):
    """Each share's mean, variance and cases against the exact law, over 4000 draws."""
    draws = [(40, 13, 20), (9, 4, 4), (1000, 30, 500), (7, 7, 3), (6, 0, 3), (60, 59, 30)]
    cases = spark.range(4000).crossJoin(spark.createDataFrame(draws, "n long, k long, d long"))
    u = F.shiftrightunsigned(F.xxhash64("id", "n", "k"), 11) / F.lit(2.0**53)
    found = mixing._hypergeometric(F.col("n"), F.col("k"), F.col("d"), u).alias("x")
    counts = Counter((r["n"], r["k"], r["d"], r["x"]) for r in cases.select("n", "k", "d", found).collect())
    for n, k, d in draws:
        for x in range(k + 1):
            p = math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d) if x <= d else 0
            got = counts[n, k, d, x] / 4000
            assert abs(got - p) <= 5 * math.sqrt(p * (1 - p) / 4000), (n, k, d, x, got, p)


def test_split_of_a_node_follows_the_multivariate_law(spark):
    """Joint shares of three sources, over 3000 nodes, against exact probabilities."""
    counts = {1: 3, 2: 4, 3: 2}
    rows = spark.range(3000).crossJoin(spark.createDataFrame(list(counts.items()), "place long, count long"))
    rows = rows.select(F.col("id").alias("node"), "place", "count", F.lit(4).cast("long").alias("half"))
    nodes = {}
    for r in mixing._split(rows, ["node"], "place", "law").collect():
        nodes.setdefault(r["node"], {})[r["place"]] = r["left"]
    got = Counter((s[1], s[2], s[3]) for s in nodes.values())
    for a in range(4):
        for b in range(5):
            c = 4 - a - b
            p = math.comb(3, a) * math.comb(4, b) * math.comb(2, c) / math.comb(9, 4) if 0 <= c <= 2 else 0
            assert abs(got[a, b, c] / 3000 - p) <= 5 * math.sqrt(p * (1 - p) / 3000), (a, b, c)
    assert sum(got.values()) == 3000


def test_mixing_in_small_blocks(spark):
    """Blocks of few words and more shards take the same documents, and every copy is in one shard."""
    rows = [(i, "w " * (1 + i * 7 % 23), "ab"[i % 5 == 0]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = mixing.mix(docs, shards=1).collect(), mixing.mix(docs, shards=16, block_words=32).collect()
    assert {r["doc_id"]: r["copies"] for r in one} == {r["doc_id"]: r["copies"] for r in two}
    words = Counter()
    for r in two:
        assert len(r["shards"]) == r["copies"] and all(0 <= s < 16 for s in r["shards"])
        words.update({s: r["size"] for s in r["shards"]})
    assert len(words) == 16


def test_fingerprints(docs, odd, empty, rows):
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for r, after in zip(order, order[1:] + order[:1]):
        text, following = r[1] or "", after[1] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        out = got[r[0]]
        assert out["n_chars"] == len(text) and out["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert out["near_next"] == 1 or text.split() != following.split()
        assert 0 <= out["near_edited"] <= 1
    assert got[6 + 7]["fingerprint"] != got[6 + 8]["fingerprint"]
    assert got[len(rows) - 1]["fingerprint"] == got[len(rows) - 2]["fingerprint"]
    assert fingerprints.fingerprints(odd).count() == odd.count()
    assert fingerprints.fingerprints(empty).count() == 0


def test_peeling_finds_the_difference():
    from panelmill.llm.scan import Scanner

    one = fingerprints.Prints(Scanner(seed=2), [" ".join(f"a{i}." for i in range(300)), "x. y. z."])
    two = fingerprints.Prints(Scanner(seed=2), [" ".join(f"a{i}." for i in range(0, 600, 2)), "x. y. w."])
    pair = np.arange(2)
    sets = [(set(one.keys[one.rows == i].tolist()), set(two.keys[two.rows == i].tolist())) for i in pair]
    weight = lambda s: sum(k & 0xFFFF for k in s)
    want = [1 - weight(a ^ b) / (weight(a) + weight(b)) for a, b in sets]
    assert fingerprints.likeness(one, pair, two, pair) == pytest.approx(want)


def test_licenses(spark, docs, odd, empty):
    known = licenses.index(spark)
    assert [r["license"] for r in licenses.scan(docs, known).collect()] == ["MIT"]
    whole = [(i, f"before {text} after") for i, (_, text) in enumerate(licenses.TEMPLATES)]
    found = licenses.scan(spark.createDataFrame(whole, "doc_id long, text string"), known).collect()
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert any(r["doc_id"] == i and r["license"] == name and r["containment"] == 1 and r["first_word"] >= 2 for r in found)
    assert licenses.scan(odd, known).count() >= 1 and licenses.scan(empty, known).count() == 0


def _language_rows():
    draw = np.random.default_rng(0)
    words = {"en": ["the", "of", "and", "thing", "with"], "fr": ["les", "été", "une", "pour", "être"], "de": ["und", "über", "der", "schön", "mit"]}
    return [(i, " ".join(draw.choice(words[k], 30)), k) for i in range(400) for k in [list(words)[i % 3]]]


def test_language(spark, docs, empty):
    table = spark.createDataFrame(_language_rows(), "doc_id long, text string, lang string")
    model = langid.fit(table.where("doc_id < 300"))
    got = langid.identify(table, model).join(table, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got if r["doc_id"] >= 300]) > 0.98
    odd = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [odd[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and odd[0]["score"] == 0 and odd[0]["rejected"]
    assert odd[_texts().index("1234 !! ??")]["lang_pred"] == "und"
    assert langid.only_known(table, model).count() >= 399
    nothing = langid.identify(docs, langid.fit(empty)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.identify(empty, model).count() == 0


def _labelled(bad):
    draw = np.random.default_rng(2)
    words = [f"wo{chr(97 + i)}rd{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = []
    for i in range(600):
        text = list(draw.choice(words, 80))
        rows.append((i, " ".join(bad(text) if i % 4 == 0 else text), int(i % 4 != 0)))
    return rows


def test_quality(spark, docs, empty):
    rows = _labelled(lambda t: [w + "###" for w in t])
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(table, labels.where("doc_id < 450 or doc_id is null"))
    got = {r["doc_id"]: r["score"] for r in quality.score(table, model).collect()}
    assert np.mean([(got[i] >= 0.3) == y for i, _, y in rows[450:]]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(docs, quality.fit(empty, labels.limit(0))).count() == docs.count()


def test_toxicity(spark, docs, empty):
    rows = _labelled(lambda t: [*t[:40], "vile", *t[40:]])
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(table, labels.where("doc_id < 450"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (y == 0) for i, _, y in rows[450:]]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs, toxicity.fit(empty, labels.limit(0))).count() == docs.count()


def test_pipeline_stages(spark, odd, empty):
    import corpus_pipeline

    for start in (odd, empty):
        docs = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert got.columns == docs.columns
                docs = spark.createDataFrame(got.collect(), docs.schema)
            got.count()

"""The registered queries on small tables: their columns, the rule of held-out rows, ids of packed pieces."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelmill.llm import catalog, packing

WORDS = {"en": "the house and this with that from have been were", "es": "la casa y esto con que desde han sido eran"}
with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
    SPEC = file.read()
TOKENIZER = Tokenizer.from_str(SPEC)


def _rows():
    rows = []
    for i in range(160):
        lang = ("en", "es")[i % 2]
        words = WORDS[lang].split()
        text = " ".join(words[(i * k) % len(words)] for k in range(1, 30 + i % 7))
        rows.append((i, text if i % 5 else text + " vile slur rotten", lang, f"s{i % 3}", len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, "123 !?", "es", None, 6), (203, "BELEDİYESİ, ANKARA. क़, שׁ.", None, "s2", 24)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = _rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(r[0] % 2 == 0), int(r[0] % 5 == 0)) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _held(doc, n, rest):
    return zlib.crc32(str(doc).encode()) % n == rest


def test_language(spark, folder):
    found = {r.doc_id: r for r in catalog.QUERIES["op3_language"](spark, folder).collect()}
    assert len(found) == len(_rows())
    for doc, text, lang, *_ in _rows():
        r = found[doc]
        assert r.held_out == _held(doc, 4, 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not text or not any(c.isalpha() for c in text))
        if doc < 160:
            assert r.lang_pred == lang


@pytest.mark.parametrize("name, threshold", [("op5_quality", 0.3), ("op7_toxicity", 0.5)])
def test_classifiers(spark, folder, name, threshold):
    found = catalog.QUERIES[name](spark, folder).collect()
    assert sorted(r.doc_id for r in found) == [r[0] for r in _rows()]
    for r in found:
        assert r.held_out == _held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


def test_packing(spark, folder):
    pieces = {}
    for r in catalog.QUERIES["op4_packing"](spark, folder).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, text, *_ in _rows():
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(pieces[doc], key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())


@pytest.mark.parametrize("ranks", [None, packing.Ranks.of(SPEC)])
def test_every_letter_before_punctuation(ranks):
    letters = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    words = [f"a{c}{end}" for c in letters for end in ("", ".", "')")]
    found = packing.WordTokens(TOKENIZER, ranks)([w.encode() for w in words])
    want = TOKENIZER.encode_batch(words, add_special_tokens=False)
    assert all(np.frombuffer(f, np.uint32).tolist() == w.ids for f, w in zip(found, want))


def test_words_by_rank():
    """Every word of the vocabulary, words joined of its entries, and words of any Latin letters."""
    draw = random.Random(4)
    entries = [t.removesuffix("</w>") for t in json.loads(SPEC)["model"]["vocab"]]
    entries = [t for t in entries if t.isascii() and t.isalpha()]
    latin = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    words = entries + ["".join(draw.choices(entries, k=draw.randint(2, 5))) for _ in range(20_000)]
    words += ["".join(draw.choices(latin, k=draw.randint(1, 40))) for _ in range(20_000)] + ["ab" * 5000, "ÅNGSTRÖM" * 300]
    found = packing.WordTokens(TOKENIZER, packing.Ranks.of(SPEC))([w.encode() for w in words])
    want = TOKENIZER.encode_batch(words, add_special_tokens=False)
    assert all(np.frombuffer(f, np.uint32).tolist() == w.ids for f, w in zip(found, want))


def test_ranks_of_other_files():
    assert packing.Ranks.of(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()) is None

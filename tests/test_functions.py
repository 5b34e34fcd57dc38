import re
import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelmill.functions import dates, headers, numbers, text

TEXTS = [
    "  Maracuyá ", "TOMATE  RIÑÓN", None, "", "santo-domingo", "o'HARA de los ríos", "straße ßig", "a b c\x0bd",
    "ﬁnca № 3½ … x", "ǅungla Ｆｕｌｌ", "日本 Ñandú 3kg", "x1y2z", "İstanbul",
]


def one(spark, rows, *columns):
    return spark.createDataFrame([(r,) for r in rows], "x string").select(*columns).collect()


def py_clean(x):
    return re.sub(r"\s+", " ", x or "").strip()


def py_key(x):
    folded = unicodedata.normalize("NFKD", py_clean(x).lower()).encode("ascii", "ignore").decode()
    return re.sub(r"\s+", " ", folded).strip()


def test_clean_and_title(spark):
    rows = one(spark, TEXTS, text.clean_text(F.col("x")).alias("c"), text.clean_text(F.col("x"), title=True).alias("t"))
    assert [r.c for r in rows] == [py_clean(x) for x in TEXTS]
    same = [i for i, x in enumerate(TEXTS) if x != "ǅungla Ｆｕｌｌ" and x != "İstanbul"]
    assert [rows[i].t for i in same] == [py_clean(TEXTS[i]).title() for i in same]


@pytest.mark.parametrize("wide", [False, True])
def test_match_key(spark, wide):
    known = TEXTS if wide else [x for x in TEXTS if x is None or not set("№ǅ") & set(x)]
    rows = one(spark, known, text.match_key(F.col("x"), wide).alias("k"))
    assert [r.k for r in rows] == [py_key(x) for x in known]


def test_expanding_characters_in_small_classes():
    pattern, table = text._expanding()
    assert max(c.count("-") for c in re.findall(r"\[(.*?)\]", pattern)) <= 16
    python = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern))
    found = {chr(c) for c in range(0x110000) if python.fullmatch(chr(c))}
    assert found == {pair.split("\x02")[0] for pair in table.split("\x01")}


def test_runs_of_blanks(spark):
    blanks = [" ", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000"]
    known = [f"a{x}{y}{z}b c{x}" for x in blanks for y in blanks for z in ["", *blanks]] + [f"{x}é" for x in blanks]
    rows = one(spark, known, text.clean_text(F.col("x")).alias("c"), text.match_key(F.col("x")).alias("k"))
    assert [r.c for r in rows] == [py_clean(x) for x in known]
    assert [r.k for r in rows] == [py_key(x) for x in known]


def test_slug_and_names(spark):
    rows = one(spark, [" Tomate Riñón (kg) ", "--"], text.slug(F.col("x")).alias("s"))
    assert [r.s for r in rows] == ["tomate_rinon_kg", ""]
    names = one(spark, ["Resumen 2020.csv", "precios.csv", "INDICES"], text.named_like(F.col("x"), ["resumen", "indice"]).alias("b"))
    assert [r.b for r in names] == [True, False, True]
    picked = spark.createDataFrame([("a", "b"), ("", "b"), (None, "c")], "x string, y string").select(
        text.pick_non_blank(F.col("x"), F.col("y")).alias("p"))
    assert [r.p for r in picked.collect()] == ["a", "b", "c"]


def test_numbers(spark):
    values = ["$1,25", "0.5", "1.234,50", "n/d", None, "1d", " 7 ", "1e3", "-.5", "", "NaN", "3."]
    rows = one(spark, values, numbers.locale_number(F.col("x")).alias("l"), numbers.plain_number(F.col("x")).alias("p"))
    assert [r.l for r in rows] == [1.25, 0.5, None, None, None, None, 7.0, 1000.0, -0.5, None, None, 3.0]
    assert [r.p for r in rows][:3] == [None, 0.5, None]


def test_scaling_blend_and_percentage(spark):
    df = spark.createDataFrame([(5.0, 0.0, 10.0), (3.0, 3.0, 3.0)], "v double, a double, b double")
    rows = df.select(
        numbers.scale(F.col("v"), F.col("a"), F.col("b")).alias("s"),
        numbers.unscale(numbers.scale(F.col("v"), F.col("a"), F.col("b")), F.col("a"), F.col("b")).alias("u"),
        numbers.blend(F.col("v"), F.col("b"), 0.25).alias("m"), numbers.percentage(F.col("a"), F.col("a")).alias("p"),
    ).collect()
    assert [r.s for r in rows] == [0.5, 0.0] and [r.u for r in rows] == [5.0, 3.0]
    assert rows[0].m == 0.75 * 5 + 0.25 * 10 and [r.p for r in rows] == [0.0, 100.0]


def test_stable_forecast(spark):
    cases = [([1.0, 2.0], [1.0]), ([-0.1], [1.0]), ([5.1], [1.0]), ([5.0], [1.0]), ([], [1.0]), ([1e9], []), ([float("nan")], [1.0])]
    df = spark.createDataFrame(cases, "f array<double>, h array<double>")
    got = [r[0] for r in df.select(numbers.stable_forecast(F.col("f"), F.col("h"))).collect()]
    assert got == [True, False, False, True, False, True, False]


def test_every_character_folds(spark):
    import unicodedata

    chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    want = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in chars}
    some = [c for i, c in enumerate(chars) if want[c] or i % 997 == 0]
    df = spark.createDataFrame([(f"a{c}z {c}",) for c in some], "x string").select("x", text.fold_ascii(F.col("x")).alias("y"))
    assert [(r.x, r.y) for r in df.collect() if r.y != f"a{want[r.x[1]]}z {want[r.x[1]]}"] == []
    odd = spark.createDataFrame([("㎏",), ("Ⅷ",), ("ﬆ",), ("10 ㎏ 𝐚",), ("…",), (None,)], "x string")
    assert [r.k for r in odd.select(text.match_key(F.col("x")).alias("k")).collect()] == ["kg", "viii", "st", "10 kg a", "...", ""]


def test_month_dates(spark):
    df = spark.createDataFrame(
        [("2020", "Enero"), ("2020", " ENE "), ("2020", "sept"), ("2020", None), ("x", "mayo"), ("2020.0", "DIC"), ("99999", "abr")],
        "ano string, mes string",
    )
    got = [r.fecha for r in dates.add_month_date(df).collect()]
    assert got == [date(2020, 1, 1), date(2020, 1, 1), None, None, None, date(2020, 12, 1), None]
    with pytest.raises(Exception, match="unreadable"):
        dates.strict_month_date(df, "ano").collect()
    full = df.select(dates.month_number(F.col("mes"), full_names_only=True).alias("m")).collect()
    assert [r.m for r in full] == [1, None, None, None, 5, None, None]


def test_calendar_and_stored_dates(spark):
    df = spark.createDataFrame([("2020-11-01",), ("bad",)], "d string").select(dates.stored_date(F.col("d")).alias("fecha"))
    rows = dates.add_calendar(df).collect()
    assert (rows[0].mes_num, rows[0].trimestre, rows[0].anio) == (11, 4, 2020) and rows[1].fecha is None
    assert rows[0].mes_sin == pytest.approx(-0.5) and rows[0].mes_cos == pytest.approx(3**0.5 / 2)


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Año Base", "Unnamed: 3", "Precio (USD/kg)"])
    assert headers.normalise_headers(df).columns == ["ano_base", "unnamed_3", "precio_usd_kg"]
    assert headers.normalise_headers(df, "loose").columns == ["año_base", "unnamed_3", "precio_usdkg"]
    assert headers.drop_unnamed(df).columns == ["Año Base", "Precio (USD/kg)"]
    assert headers.find_column(df, "Precio") == "Precio (USD/kg)"
    assert headers.first_present(df, "anio", "Año Base") == "Año Base"
    with pytest.raises(ValueError, match="producto"):
        headers.require_columns(df, ["producto"])
    assert not headers.has_table_shape(df.select("Año Base")) and headers.has_table_shape(df)


def test_wide_folding_holds_a_slice(spark, monkeypatch):
    """Values of a batch are decomposed in slices, and only those beyond ascii."""
    import pyarrow as pa

    sizes = []
    monkeypatch.setattr(text, "SLICE", 100)
    monkeypatch.setattr(text, "_ascii", lambda t, fold=text._ascii: sizes.append(len(t)) or fold(t))
    values = ["plain", None, "", "Ñandú " * 30, "ﬁn ½", "x" * 500, "日本"]
    got = text._fold_wide.func(pa.array(values)).to_pylist()
    assert got == ["plain", None, "", "Nandu " * 30, "fin 12", "x" * 500, ""] and len(sizes) == 3
    assert text._fold_wide.func(pa.array([], pa.string())).to_pylist() == []
    frame = spark.createDataFrame([(v,) for v in values], "v string").select(text.fold_ascii(F.col("v"), wide=True).alias("w"))
    assert [r.w for r in frame.collect()] == got

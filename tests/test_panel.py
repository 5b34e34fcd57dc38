from datetime import date
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.constants import FULL_FEATURES, TARGET
from panelmill.plans import legacy, panel
from panelmill.session import materialise, scratch_dir
from panelmill.sources.store import read_json, save_json

NAMES = ["Enero", "febrero", "MAR", "abr", "mayo", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]


def raw_frames(spark, years=(2015, 2016, 2017)):
    market, producer, inputs, ipc, index = [], [], [], [], []
    for y in years:
        for i, m in enumerate(NAMES):
            t = (y - 2015) * 12 + i
            for p in ("Loja", " loja ", "Santo-Domingo"):
                market.append((str(y), m, p, "Maracuyá" if i % 2 else "MARACUYA", f"m{i % 3}", "t", f"${1 + t / 10:.2f}".replace(".", ","), "2"))
            market.append((str(y), m, "Azuay", "Maracuyá", "m", "t", "5", "5"))
            if i not in (3, 4):
                producer.append((str(y), m, "LOJA", "maracuya", f"{t / 10 + .5:.2f}"))
            producer.append((str(y), m, "Santo-Domingo", "Maracuyá", "n/d" if i == 6 else "1"))
            inputs += [(str(y), m, "Loja", "Fertilizantes", "urea", str(t + k)) for k in range(4)] + [(str(y), m, "Loja", "Otros", "x", "99")]
            if t < 34:
                ipc.append((date(y, i + 1, 1), 100.0 + t, 0.1, 0.2, 0.3))
                index.append((date(y, i + 1, 1), 50.0 + t))
    market.append(("2016", "sept", "Loja", "Maracuya", "m", "t", "1", "1"))
    schema = "ano string, mes string, provincia string, producto string, mercado string, tipo_mercado string, precio_promedio_usdkg string, promedio_de_precio_usd string"
    macro = {"ipc": spark.createDataFrame(ipc, "fecha date, ipc_alimentos double, inflacion_mensual double, inflacion_anual double, inflacion_acumulada double")}
    for name in ("ibc", "ipm", "ipp_n"):
        macro[name] = spark.createDataFrame(index, f"fecha date, {name} double")
    return (
        spark.createDataFrame(market, schema),
        spark.createDataFrame(producer, "ano string, mes string, provincia string, producto string, precio_promedio_usdkg string"),
        spark.createDataFrame(inputs, "ano string, mes string, provincia string, tipo_insumo string, ingrediente_activo string, promedio_de_precio string"),
        macro,
    )


@pytest.fixture(scope="module")
def built(spark):
    return panel.PanelInputs(*raw_frames(spark))


def test_panel_inputs(built):
    market = built.market.toPandas()
    assert set(market.provincia_key) == {"loja", "santo-domingo"} and set(market.provincia) == {"Loja", "Santo-Domingo"}
    assert market.fecha.min() == date(2016, 1, 1) and len(market) == 48
    first = market[(market.provincia_key == "loja") & (market.fecha == date(2016, 1, 1))].iloc[0]
    assert first.mercados_observaciones == 2 and first[TARGET] == pytest.approx(2.2) and first.mercados_distintos == 1
    fert = {(r.provincia_key, r.fecha): r for r in built.inputs.collect()}[("loja", date(2016, 1, 1))]
    assert fert.fertilizantes_precio_mediano_provincia == 13.5 and fert.fertilizantes_registros_provincia == 4
    assert fert.fertilizantes_ingredientes_activos_provincia == 1


def test_fills_and_features(built):
    wide = built.wide().toPandas().sort_values(["provincia_key", "fecha"])
    loja = wide[wide.provincia_key == "loja"].set_index("fecha")
    april = loja.loc[date(2016, 4, 1)]
    assert april.productor_missing_exact == 1 and april.precio_productor_usdkg_filled == 1.0  # national price of the month
    late = loja.loc[date(2017, 12, 1)]
    assert late.macro_missing_any == 1 and late.ipc_alimentos == 133.0
    assert loja[TARGET].shift(3).dropna().tolist() == loja.target_lag_3.dropna().tolist()
    assert set(wide.provincia_id) == {0, 1} and (loja.provincia_id == 0).all()
    complete = built.dataset().toPandas()
    assert complete[[TARGET, *FULL_FEATURES]].notna().all().all() and len(complete) == 24


def test_lazy_and_staged_agree(spark, built):
    lazy = panel.PanelInputs(*raw_frames(spark), stage=panel.as_is).dataset()
    key = ["provincia_key", "fecha"]
    a = lazy.toPandas().sort_values(key).reset_index(drop=True)
    b = built.dataset().toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_summary_and_metadata(spark, built, tmp_path):
    summary = panel.preprocessing_summary(built.wide()).collect()[0]
    assert (summary.registros_iniciales, summary.registros_finales, summary.pct_eliminado) == (48, 24, 50.0)
    meta = panel.dataset_metadata(built.wide())
    save_json(meta, str(tmp_path / "meta"))
    back = read_json(spark, str(tmp_path / "meta")).collect()[0]
    assert back.shared_provinces == ["Loja", "Santo-Domingo"] and back.date_min == "2017-01-01"
    assert len(back.feature_groups.lag_features) == 20 and back.preprocessing_summary.registros_finales == 24


def test_product_selection(spark):
    frames = raw_frames(spark)
    assert panel.market_panel(frames[0], ["papa"]).count() == 0 and panel.market_panel(frames[0], ["maracuya"]).count() > 0


def test_legacy_series(spark):
    months = [d.date() for d in pd.date_range("2015-10-01", periods=14, freq="MS")]
    prices = spark.createDataFrame([(d, 18.1437 * (i + 1)) for i, d in enumerate(months)], "fecha date, box double")
    series = legacy.box_price_series(prices, "box")
    def other(name, skip):
        return spark.createDataFrame([(d, float(i)) for i, d in enumerate(months) if i not in skip], f"fecha date, {name} double")
    merged = legacy.merge_series(series, other("ipc", {13}), other("fertilizantes", set()), other("precio_productor_banano", {0, 1, 2, 3, 4}), other("ipp", {5}), "2016-01-01")
    rows = merged.orderBy("fecha").collect()
    assert rows[0].precio_productor_banano == 5.0 and rows[-1].ipc == 12.0 and rows[2].ipp == 4.0
    lagged = legacy.add_series_lags(merged).orderBy("fecha").collect()
    assert len(lagged) == 5 and lagged[0].lag_6 == pytest.approx(4) and lagged[0].rolling_mean_3 == pytest.approx(9) and lagged[0].diff_2 == pytest.approx(2)
    dirty = spark.createDataFrame([(1, 2), (1, 2)], [" A B", "c"])
    assert legacy.clean_frame(dirty).columns == ["a_b", "c"] and legacy.clean_frame(dirty).count() == 1


def test_scratch_follows_the_session(spark):
    configured = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "/shared/work/"}[key]))
    assert scratch_dir(configured) == "/shared/work"
    assert scratch_dir(spark) == scratch_dir(spark) and materialise(spark.range(3), "x").count() == 3

"""Panel assembly, fills, features and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.common import (
    DATASET, EXOGENOUS_LAG_SQL, FILLED, INPUT_PANEL, JOINED, MACRO, MARKET_PANEL, PRODUCER, PRODUCER_PANEL, SHARED,
    START, WIDE, inputs, keyed, market_series, query, rounded, sql_round, sql_rounded,
)
from panelmill.constants import (
    EXOGENOUS_LAGS, FERTILISER_COLUMNS, FULL_FEATURES, MACRO_COLUMNS, MARKET_CONTEXT_FEATURES, PRODUCER_COLUMNS,
    ROLLING_SIZES, TARGET, TARGET_LAGS,
)
from panelmill.functions.dates import add_calendar
from panelmill.operators.summaries import monthly_means
from panelmill.operators.windows import ENTITY, add_lag_features, entity_window, target_lag_columns
from panelmill.plans import legacy, panel
from panelmill.sources import driver_tables as dt

KEYS = ["product_key", "provincia_key", "fecha"]
KEY_SQL = ", ".join(KEYS)
PRICES = [TARGET, "target_precio_mercado_usd"]


def market_panel(spark, sf):
    return rounded(panel.market_panel(dt.market_prices(spark, sf)))


def producer_panel(spark, sf):
    return rounded(panel.producer_panel(panel.producer_cells(dt.producer_prices(spark, sf))))


def producer_national(spark, sf):
    return rounded(panel.producer_national(panel.producer_cells(dt.producer_prices(spark, sf))))


def _input_cells(spark, sf):
    return panel.input_cells(dt.input_prices(spark, sf), dt.INPUT_CATEGORY)


def input_price_panel(spark, sf):
    return rounded(panel.input_panel(_input_cells(spark, sf)))


def input_price_national(spark, sf):
    return rounded(panel.input_national(_input_cells(spark, sf)))


def macro_series(spark, sf):
    return rounded(panel.assemble_macro(dt.macro_sources(spark, sf)))


def shared_entities(spark, sf):
    given = inputs(spark, sf)
    return given.market.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("months"), F.min("fecha").alias("first"), F.max("fecha").alias("last")
    ).join(panel.province_ids(given.market), ENTITY)


JOINED_COLUMNS = [
    *PRICES, "precio_productor_provincia_usdkg", "precio_productor_nacional_usdkg",
    "fertilizantes_precio_promedio_provincia", "fertilizantes_precio_mediano_provincia",
    "inflacion_mensual", "inflacion_anual", "inflacion_acumulada",
]
JOINED_COUNTS = [
    *MARKET_CONTEXT_FEATURES, "productor_observaciones_provincia", "productor_observaciones_nacional",
    "fertilizantes_registros_provincia", "fertilizantes_registros_nacional",
    "fertilizantes_ingredientes_activos_provincia", "provincia_id",
]


def panel_joined(spark, sf):
    return rounded(inputs(spark, sf).joined().select(*KEYS, *JOINED_COLUMNS, *JOINED_COUNTS))


def exogenous_filled(spark, sf):
    filled = panel.fill_exogenous(inputs(spark, sf).joined())
    return rounded(filled.select(*KEYS, *PRODUCER_COLUMNS, *FERTILISER_COLUMNS, *MACRO_COLUMNS, "macro_missing_any"))


def calendar_features(spark, sf):
    dates = dt.market_prices(spark, sf).select("fecha").distinct()
    return rounded(add_calendar(dates), 9)


def lag_features(spark, sf):
    series = market_series(spark, sf)
    lags = {n: c for n, c in target_lag_columns(entity_window()).items() if "lag" in n or "momentum" in n}
    return rounded(series.withColumns(lags).select(*KEYS, *lags))


def rolling_features(spark, sf):
    series = market_series(spark, sf)
    rolled = {n: c for n, c in target_lag_columns(entity_window()).items() if "rolling" in n}
    return rounded(series.withColumns(rolled).select(*KEYS, *rolled), 4)


def exogenous_lags(spark, sf):
    lagged = add_lag_features(panel.fill_exogenous(inputs(spark, sf).joined()))
    return rounded(lagged.select(*KEYS, *EXOGENOUS_LAGS))


def feature_dataset(spark, sf):
    return rounded(inputs(spark, sf).dataset().select(*KEYS, "producto", "provincia", TARGET, *FULL_FEATURES), 4)


def feature_dataset_base(spark, sf):
    from panelmill.sources.store import load_bundle

    bundle = load_bundle(inputs(spark, sf).dataset(), "base", check="plan")
    return rounded(bundle.data.select(*KEYS, bundle.target, *bundle.features), 4)


def preprocessing_summary(spark, sf):
    return panel.preprocessing_summary(inputs(spark, sf).wide())


def dataset_metadata(spark, sf):
    document = panel.dataset_metadata(inputs(spark, sf).wide())
    return document.select(
        "product_key", "rows_before_lag_drop", "rows_final_dataset", "date_min", "date_max", "shared_provinces_count",
        F.array_join("shared_provinces", "|").alias("shared_provinces"), "productor_exact_match_rows",
        "productor_exact_match_pct", F.size("full_model_features").alias("full_features"),
        F.size("feature_groups.lag_features").alias("lag_features"),
        F.col("preprocessing_summary.pct_eliminado").alias("pct_eliminado"),
    )


def historical_prices(spark, sf):
    return rounded(monthly_means(market_series(spark, sf), ["product_key", "fecha"], {"precio": TARGET}))


def _legacy(spark, sf):
    macro = dt.macro_sources(spark, sf)
    prices = legacy.box_price_series(dt.market_prices(spark, sf), "promedio_de_precio_usd")
    producer = legacy.product_series(dt.producer_prices(spark, sf), "brand#1")
    fertiliser = legacy.input_series(dt.input_prices(spark, sf), "ECONOMY")
    ipc = macro["ipc"].select("fecha", F.col("ipc_alimentos").alias("ipc"))
    ipp = macro["ibc"].select("fecha", F.col("ibc").alias("ipp"))
    return legacy.merge_series(prices, ipc, fertiliser, producer, ipp, START)


def legacy_series_features(spark, sf):
    return rounded(legacy.add_series_lags(_legacy(spark, sf)), 5)


QUERIES = {
    f.__name__: f
    for f in (
        market_panel, producer_panel, producer_national, input_price_panel, input_price_national, macro_series,
        shared_entities, panel_joined, exogenous_filled, calendar_features, lag_features, rolling_features,
        exogenous_lags, feature_dataset, feature_dataset_base, preprocessing_summary, dataset_metadata,
        historical_prices, legacy_series_features,
    )
}

LAGGED = ", ".join(
    [f"{sql_rounded(f'lag({TARGET}, {k}) OVER w')} AS {n}" for n, k in TARGET_LAGS.items()]
    + [
        f"{sql_rounded(f'lag({TARGET}, 1) OVER w - lag({TARGET}, {k}) OVER w')} AS target_momentum_1_{k}"
        for k in (3, 6)
    ]
)


def _rolled(stat, size):
    frame = f"OVER (w ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    return sql_rounded(f"CASE WHEN count({TARGET}) {frame} = {size} THEN {stat}({TARGET}) {frame} END", 4)


ROLLED = ", ".join(
    f"{_rolled(stat, n)} AS target_rolling_{a}_{n}"
    for n in ROLLING_SIZES
    for stat, a in (("avg", "mean"), ("stddev_samp", "std"))
)
ENTITY_WINDOW = "WINDOW w AS (PARTITION BY product_key, provincia_key ORDER BY fecha)"

SUMMARY_SQL = """
SELECT product_key, count(*) AS registros_iniciales, count(*) - count(*) FILTER (ok) AS registros_eliminados,
       round((count(*) - count(*) FILTER (ok)) / count(*) * 100, 2) AS pct_eliminado,
       coalesce(sum(productor_missing_exact) FILTER (ok), 0)::BIGINT AS productor_imputado,
       CASE WHEN count(*) FILTER (ok) > 0 THEN round(sum(productor_missing_exact) FILTER (ok) / count(*) FILTER (ok) * 100, 2) ELSE 0.0::DOUBLE END AS pct_productor_imputado,
       coalesce(sum(fertilizantes_missing_exact) FILTER (ok), 0)::BIGINT AS fertilizantes_imputado,
       CASE WHEN count(*) FILTER (ok) > 0 THEN round(sum(fertilizantes_missing_exact) FILTER (ok) / count(*) FILTER (ok) * 100, 2) ELSE 0.0::DOUBLE END AS pct_fertilizantes_imputado,
       coalesce(sum(macro_missing_any) FILTER (ok), 0)::BIGINT AS macro_completado,
       CASE WHEN count(*) FILTER (ok) > 0 THEN round(sum(macro_missing_any) FILTER (ok) / count(*) FILTER (ok) * 100, 2) ELSE 0.0::DOUBLE END AS pct_macro_completado,
       count(*) FILTER (ok) AS registros_finales
FROM marked GROUP BY 1"""
from panelmill.catalog.common import COMPLETE_SQL  # noqa: E402

MARKED = f"{WIDE},\nmarked AS (SELECT *, ({COMPLETE_SQL}) AS ok FROM wide)"

LEGACY_SQL = query(
    f"""{MARKET_PANEL},{PRODUCER},{keyed('producer_prices')},{INPUT_PANEL},{MACRO},
s AS (
  SELECT b.fecha, b.y AS precio_banano_internacional,
         last_value(ipc_alimentos IGNORE NULLS) OVER f AS ipc,
         coalesce(last_value(pp IGNORE NULLS) OVER f, first_value(pp IGNORE NULLS) OVER g) AS precio_productor_banano,
         a.fertilizantes,
         coalesce(last_value(m.ibc IGNORE NULLS) OVER f, first_value(m.ibc IGNORE NULLS) OVER g) AS ipp
  FROM (SELECT fecha, avg(promedio_de_precio_usd / 18.1437::DOUBLE) AS y FROM market_prices GROUP BY 1) b
  LEFT JOIN macro m USING (fecha)
  LEFT JOIN (SELECT fecha, avg(promedio_de_precio) AS fertilizantes FROM input_prices
             WHERE tipo_insumo = 'ECONOMY' GROUP BY 1) a USING (fecha)
  LEFT JOIN (SELECT fecha, avg(precio_promedio_usdkg) AS pp FROM producer_prices
             WHERE lower(producto) LIKE '%brand#1%' GROUP BY 1) p USING (fecha)
  WINDOW f AS (ORDER BY b.fecha ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         g AS (ORDER BY b.fecha ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (
  SELECT *, {", ".join(f"lag(precio_banano_internacional, {k}) OVER w AS lag_{k}" for k in range(1, 7))},
         precio_banano_internacional - lag(precio_banano_internacional, 1) OVER w AS diff_1,
         precio_banano_internacional - lag(precio_banano_internacional, 2) OVER w AS diff_2,
         avg(precio_banano_internacional) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_mean_3,
         stddev_samp(precio_banano_internacional) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_std_3
  FROM s WHERE fecha >= DATE '{START}' WINDOW w AS (ORDER BY fecha))""",
    "SELECT fecha, "
    + sql_round(
        ["precio_banano_internacional", "ipc", "precio_productor_banano", "fertilizantes", "ipp"]
        + [f"lag_{k}" for k in range(1, 7)] + ["diff_1", "diff_2", "rolling_mean_3", "rolling_std_3"], 5,
    )
    + " FROM l WHERE lag_6 IS NOT NULL AND ipc IS NOT NULL AND precio_productor_banano IS NOT NULL"
    " AND fertilizantes IS NOT NULL AND ipp IS NOT NULL",
)

FERTILISER_NUMBERS = [c for c in FERTILISER_COLUMNS if "precio" in c]
FERTILISER_INTS = [c for c in FERTILISER_COLUMNS if "precio" not in c]
PRODUCER_NUMBERS = [c for c in PRODUCER_COLUMNS if "precio" in c]
PRODUCER_INTS = [c for c in PRODUCER_COLUMNS if "precio" not in c]
INTEGER_FEATURES = [
    "provincia_id", "mes_num", "trimestre", "productor_missing_exact", "fertilizantes_registros_provincia",
    "fertilizantes_ingredientes_activos_provincia", "fertilizantes_missing_exact",
]
DOUBLE_FEATURES = [c for c in FULL_FEATURES if c not in INTEGER_FEATURES]
BASE_DOUBLES = [c for c in DOUBLE_FEATURES if c.startswith(("mes_", "target_"))]

ORACLES = {
    "market_panel": query(
        MARKET_PANEL,
        f"SELECT {KEY_SQL}, provincia, producto, {sql_round(PRICES)}, {', '.join(MARKET_CONTEXT_FEATURES)} FROM market_panel_all",
    ),
    "producer_panel": query(
        PRODUCER_PANEL,
        f"SELECT {KEY_SQL}, provincia, producto, {sql_round(['precio_productor_provincia_usdkg'])},"
        " productor_observaciones_provincia FROM producer_panel",
    ),
    "producer_national": query(
        PRODUCER_PANEL,
        f"SELECT product_key, fecha, {sql_round(['precio_productor_nacional_usdkg'])},"
        " productor_observaciones_nacional FROM producer_national",
    ),
    "input_price_panel": query(
        INPUT_PANEL,
        "SELECT fecha, provincia_key, provincia, "
        + sql_round(["fertilizantes_precio_promedio_provincia", "fertilizantes_precio_mediano_provincia"])
        + ", fertilizantes_registros_provincia, fertilizantes_ingredientes_activos_provincia FROM input_panel",
    ),
    "input_price_national": query(
        INPUT_PANEL,
        "SELECT fecha, "
        + sql_round(["fertilizantes_precio_promedio_nacional", "fertilizantes_precio_mediano_nacional"])
        + ", fertilizantes_registros_nacional FROM input_national",
    ),
    "macro_series": query(MACRO, f"SELECT fecha, {sql_round(MACRO_COLUMNS)} FROM macro"),
    "shared_entities": query(
        SHARED,
        """SELECT product_key, provincia_key, count(*) AS months, min(fecha) AS first, max(fecha) AS last,
       row_number() OVER (PARTITION BY product_key ORDER BY min(provincia)) - 1 AS provincia_id
FROM market_panel GROUP BY 1, 2""",
    ),
    "panel_joined": query(
        JOINED, f"SELECT {KEY_SQL}, {sql_round(JOINED_COLUMNS)}, {', '.join(JOINED_COUNTS)} FROM joined"
    ),
    "exogenous_filled": query(
        FILLED,
        f"SELECT {KEY_SQL}, {sql_round(PRODUCER_NUMBERS + FERTILISER_NUMBERS + MACRO_COLUMNS)},"
        f" {', '.join(PRODUCER_INTS + FERTILISER_INTS)}, macro_missing_any FROM filled",
    ),
    "calendar_features": """
SELECT fecha, year(fecha) AS anio, month(fecha) AS mes_num, quarter(fecha) AS trimestre,
       floor(sin(2 * pi() * month(fecha) / 12) * 1e9 + 0.50137::DOUBLE) / 1e9 AS mes_sin,
       floor(cos(2 * pi() * month(fecha) / 12) * 1e9 + 0.50137::DOUBLE) / 1e9 AS mes_cos
FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS fecha
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN part ON l_partkey = p_partkey) d""",
    "lag_features": query(SHARED, f"SELECT {KEY_SQL}, {LAGGED} FROM market_panel {ENTITY_WINDOW}"),
    "rolling_features": query(SHARED, f"SELECT {KEY_SQL}, {ROLLED} FROM market_panel {ENTITY_WINDOW}"),
    "exogenous_lags": query(
        f"{FILLED},\nlagged AS (SELECT {KEY_SQL}, {EXOGENOUS_LAG_SQL} FROM filled {ENTITY_WINDOW})",
        f"SELECT {KEY_SQL}, {sql_round(list(EXOGENOUS_LAGS))} FROM lagged",
    ),
    "feature_dataset": query(
        DATASET,
        f"SELECT {KEY_SQL}, producto, provincia, {sql_round([TARGET, *DOUBLE_FEATURES], 4)},"
        f" {', '.join(INTEGER_FEATURES)} FROM dataset",
    ),
    "feature_dataset_base": query(
        DATASET,
        f"SELECT {KEY_SQL}, {sql_round([TARGET, *BASE_DOUBLES], 4)}, provincia_id, mes_num, trimestre FROM dataset",
    ),
    "preprocessing_summary": query(MARKED, SUMMARY_SQL),
    "dataset_metadata": query(
        MARKED,
        f"""
SELECT product_key, count(*) AS rows_before_lag_drop, count(*) FILTER (ok) AS rows_final_dataset,
       strftime(min(fecha) FILTER (ok), '%Y-%m-%d') AS date_min, strftime(max(fecha) FILTER (ok), '%Y-%m-%d') AS date_max,
       count(DISTINCT provincia) AS shared_provinces_count,
       string_agg(DISTINCT provincia, '|' ORDER BY provincia) AS shared_provinces,
       count(*) FILTER (productor_missing_exact = 0) AS productor_exact_match_rows,
       round(count(*) FILTER (productor_missing_exact = 0) / count(*), 4) AS productor_exact_match_pct,
       {len(FULL_FEATURES)} AS full_features, 20 AS lag_features,
       round((count(*) - count(*) FILTER (ok)) / count(*) * 100, 2) AS pct_eliminado
FROM marked GROUP BY 1""",
    ),
    "historical_prices": query(
        SHARED, f"SELECT product_key, fecha, {sql_rounded(f'avg({TARGET})')} AS precio FROM market_panel GROUP BY 1, 2"
    ),
    "legacy_series_features": LEGACY_SQL,
}

"""Frames and SQL fragments the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.constants import FULL_FEATURES, MIN_ENTITY_ROWS, TARGET
from panelmill.plans.evaluation import Evaluation
from panelmill.plans.panel import PanelInputs
from panelmill.session import materialise
from panelmill.sources import driver_tables as dt

# Panels start with the data; `START` is the bound that legacy_series_features shows.
ALL_DATES = "0001-01-01"
START = "1996-01-01"
HALF = 0.50137


# Staged tables of this application, by folder of the given tables.
_inputs: dict[tuple[str, str], PanelInputs] = {}
_datasets: dict[tuple[str, str], DataFrame] = {}


def inputs(spark: SparkSession, sf_dir: str) -> PanelInputs:
    """Panels of the given tables; their staged cells are shared by all queries of a session."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _inputs:
        _inputs[place] = PanelInputs(
            dt.market_prices(spark, sf_dir), dt.producer_prices(spark, sf_dir), dt.input_prices(spark, sf_dir),
            dt.macro_sources(spark, sf_dir), category=dt.INPUT_CATEGORY, start=ALL_DATES,
        )
    return _inputs[place]


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature dataset as a stored table, from which training and evaluation start."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _datasets:
        _datasets[place] = materialise(inputs(spark, sf_dir).dataset(), "dataset")
    return _datasets[place]


def evaluation(spark: SparkSession, sf_dir: str) -> Evaluation:
    return Evaluation(dataset(spark, sf_dir), MIN_ENTITY_ROWS)


def market_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market panel alone: product, province, month and target."""
    return inputs(spark, sf_dir).market.select("product_key", "provincia_key", "provincia", "producto", "fecha", TARGET)


def rounded(df: DataFrame, digits: int = 5, only: list[str] | None = None) -> DataFrame:
    """Doubles rounded for output; what lies within float noise below a tie counts as a tie.

    Sums of the same values in another order differ in the last bit, and prices are often exact
    ties, so plain rounding would depend on the partitioning.
    """
    names = only or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    factor = F.lit(float(10**digits))
    return df.withColumns({c: F.floor(F.col(c) * factor + HALF) / factor for c in names})


# ---- SQL side -----------------------------------------------------------------------------

BLANK_CLASS = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{BLANK_CLASS}', ' ', 'g'))"


def sql_title(x: str) -> str:
    words = rf"regexp_extract_all({x}, '[\p{{L}}]+|[^\p{{L}}]+')"
    return f"array_to_string(list_transform({words}, lambda w: CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '')"


def sql_fold(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def sql_key(x: str) -> str:
    return f"trim(regexp_replace({sql_fold(f'lower({sql_clean(x)})')}, '{BLANK_CLASS}', ' ', 'g'))"


def sql_rounded(x: str, digits: int = 5) -> str:
    return f"floor(({x}) * 1e{digits} + {HALF}::DOUBLE) / 1e{digits}"


def sql_round(columns: list[str], digits: int = 5) -> str:
    return ", ".join(f"{sql_rounded(c, digits)} AS {c}" for c in columns)


MARKET = """
market_prices AS (
  SELECT p_brand AS producto, n_name AS provincia, c_mktsegment AS mercado, o_orderpriority AS tipo_mercado,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS fecha,
         l_extendedprice / l_quantity AS precio_promedio_usdkg, l_extendedprice AS promedio_de_precio_usd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

PRODUCER = """
producer_prices AS (
  SELECT p_brand AS producto, n_name AS provincia, CAST(date_trunc('month', l_shipdate) AS DATE) AS fecha,
         l_extendedprice * (1 - l_discount) / l_quantity AS precio_promedio_usdkg
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey)"""

INPUT = """
input_prices AS (
  SELECT p_type AS tipo_insumo, p_name AS ingrediente_activo, n_name AS provincia,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS fecha, l_extendedprice AS promedio_de_precio
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey)"""

MACRO = """
macro AS (
  SELECT fecha, ipc_alimentos,
         100 * (ipc_alimentos / lag(ipc_alimentos, 1) OVER (ORDER BY fecha) - 1) AS inflacion_mensual,
         100 * (ipc_alimentos / lag(ipc_alimentos, 12) OVER (ORDER BY fecha) - 1) AS inflacion_anual,
         100 * (ipc_alimentos / first_value(ipc_alimentos) OVER (PARTITION BY year(fecha) ORDER BY fecha) - 1)
           AS inflacion_acumulada, ibc, ipm, ipp_n
  FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha, avg(o_totalprice) AS ipc_alimentos,
               avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS ibc, max(o_totalprice) AS ipm,
               avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS ipp_n
        FROM orders GROUP BY 1) m)"""


def keyed(source: str) -> str:
    return f"""
{source}_k AS (
  SELECT * REPLACE ({sql_title(sql_clean('provincia'))} AS provincia, {sql_clean('producto')} AS producto),
         {sql_key('provincia')} AS provincia_key, {sql_key('producto')} AS product_key
  FROM {source})"""


def sql_mode(table: str, keys: str, value: str) -> str:
    """Most common non-blank value per key, ties to the smallest."""
    return f"""
{table}_{value} AS (
  SELECT {keys}, first({value} ORDER BY n DESC, {value}) AS {value}
  FROM (SELECT {keys}, {value}, count(*) AS n FROM {table}_k WHERE trim({value}) <> '' GROUP BY ALL) c
  GROUP BY ALL)"""


MARKET_PANEL = f"""{MARKET},{keyed('market_prices')},
{sql_mode('market_prices', 'product_key, fecha, provincia_key', 'provincia')},
{sql_mode('market_prices', 'product_key, fecha, provincia_key', 'producto')},
market_panel_all AS (
  SELECT k.*, p.provincia, q.producto FROM (
    SELECT product_key, fecha, provincia_key, avg(precio_promedio_usdkg) AS target_precio_mercado_usdkg,
           avg(promedio_de_precio_usd) AS target_precio_mercado_usd, count(*) AS mercados_observaciones,
           count(DISTINCT mercado) AS mercados_distintos, count(DISTINCT tipo_mercado) AS tipos_mercado_distintos
    FROM market_prices_k GROUP BY 1, 2, 3) k
  JOIN market_prices_provincia p USING (product_key, fecha, provincia_key)
  JOIN market_prices_producto q USING (product_key, fecha, provincia_key))"""

PRODUCER_PANEL = f"""{PRODUCER},{keyed('producer_prices')},
producer_panel AS (
  SELECT product_key, fecha, provincia_key, min(provincia) AS provincia, min(producto) AS producto,
         avg(precio_promedio_usdkg) AS precio_productor_provincia_usdkg,
         count(*) AS productor_observaciones_provincia
  FROM producer_prices_k GROUP BY 1, 2, 3),
producer_national AS (
  SELECT product_key, fecha, avg(precio_promedio_usdkg) AS precio_productor_nacional_usdkg,
         count(*) AS productor_observaciones_nacional
  FROM producer_prices_k GROUP BY 1, 2)"""

INPUT_PANEL = f"""{INPUT},
input_rows AS (
  SELECT fecha, {sql_title(sql_clean('provincia'))} AS provincia, {sql_key('provincia')} AS provincia_key,
         {sql_clean('ingrediente_activo')} AS ingrediente_activo, promedio_de_precio
  FROM input_prices WHERE {sql_key('tipo_insumo')} = 'economy'),
input_panel AS (
  SELECT fecha, provincia_key, min(provincia) AS provincia,
         avg(promedio_de_precio) AS fertilizantes_precio_promedio_provincia,
         quantile_cont(promedio_de_precio, 0.5) AS fertilizantes_precio_mediano_provincia,
         count(*) AS fertilizantes_registros_provincia,
         count(DISTINCT ingrediente_activo) AS fertilizantes_ingredientes_activos_provincia
  FROM input_rows GROUP BY 1, 2),
input_national AS (
  SELECT fecha, avg(promedio_de_precio) AS fertilizantes_precio_promedio_nacional,
         quantile_cont(promedio_de_precio, 0.5) AS fertilizantes_precio_mediano_nacional,
         count(*) AS fertilizantes_registros_nacional
  FROM input_rows GROUP BY 1)"""

SHARED = f"""{MARKET_PANEL},{PRODUCER_PANEL},
market_panel AS (
  SELECT * FROM market_panel_all m
  WHERE EXISTS (SELECT 1 FROM producer_panel p
                WHERE p.product_key = m.product_key AND p.provincia_key = m.provincia_key)
    AND fecha >= DATE '{ALL_DATES}')"""

JOINED = f"""{SHARED},{INPUT_PANEL},{MACRO},
ids AS (
  SELECT product_key, provincia_key,
         row_number() OVER (PARTITION BY product_key ORDER BY provincia, provincia_key) - 1 AS provincia_id
  FROM (SELECT product_key, provincia_key, min(provincia) AS provincia FROM market_panel GROUP BY 1, 2) d),
joined AS (
  SELECT m.*, p.precio_productor_provincia_usdkg, p.productor_observaciones_provincia,
         pn.precio_productor_nacional_usdkg, pn.productor_observaciones_nacional,
         i.fertilizantes_precio_promedio_provincia, i.fertilizantes_precio_mediano_provincia,
         i.fertilizantes_registros_provincia, i.fertilizantes_ingredientes_activos_provincia,
         n.fertilizantes_precio_promedio_nacional, n.fertilizantes_precio_mediano_nacional,
         n.fertilizantes_registros_nacional,
         ipc_alimentos, inflacion_mensual, inflacion_anual, inflacion_acumulada, ibc, ipm, ipp_n, provincia_id
  FROM market_panel m
  LEFT JOIN producer_panel p USING (product_key, fecha, provincia_key)
  LEFT JOIN producer_national pn USING (product_key, fecha)
  LEFT JOIN input_panel i USING (fecha, provincia_key)
  LEFT JOIN input_national n USING (fecha)
  LEFT JOIN macro USING (fecha)
  LEFT JOIN ids USING (product_key, provincia_key))"""

ENTITY_SQL = "PARTITION BY product_key, provincia_key ORDER BY fecha"


def _ffill(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


MACRO_NAMES = ["ipc_alimentos", "inflacion_mensual", "inflacion_anual", "inflacion_acumulada", "ibc", "ipm", "ipp_n"]

FILLED = f"""{JOINED},
flagged AS (
  SELECT * REPLACE ({", ".join(f"{_ffill(c)} AS {c}" for c in MACRO_NAMES)}),
         (precio_productor_provincia_usdkg IS NULL)::INT AS productor_missing_exact,
         (fertilizantes_precio_promedio_provincia IS NULL)::INT AS fertilizantes_missing_exact,
         ({" OR ".join(f"{c} IS NULL" for c in MACRO_NAMES)})::INT AS macro_missing_any,
         {_ffill("coalesce(precio_productor_provincia_usdkg, precio_productor_nacional_usdkg)")}
           AS precio_productor_usdkg_filled,
         {_ffill("coalesce(fertilizantes_precio_promedio_provincia, fertilizantes_precio_promedio_nacional)")}
           AS fertilizantes_precio_promedio_filled
  FROM joined WINDOW w AS ({ENTITY_SQL})),
filled AS (
  SELECT * REPLACE (
    coalesce(precio_productor_provincia_usdkg, precio_productor_usdkg_filled) AS precio_productor_provincia_usdkg,
    coalesce(precio_productor_nacional_usdkg, precio_productor_usdkg_filled) AS precio_productor_nacional_usdkg,
    coalesce(fertilizantes_precio_promedio_provincia, fertilizantes_precio_promedio_filled)
      AS fertilizantes_precio_promedio_provincia,
    coalesce(fertilizantes_precio_promedio_nacional, fertilizantes_precio_promedio_filled)
      AS fertilizantes_precio_promedio_nacional,
    coalesce(fertilizantes_precio_mediano_provincia, fertilizantes_precio_mediano_nacional)
      AS fertilizantes_precio_mediano_provincia,
    coalesce(fertilizantes_precio_mediano_nacional, fertilizantes_precio_mediano_provincia)
      AS fertilizantes_precio_mediano_nacional,
    coalesce(productor_observaciones_provincia, 0) AS productor_observaciones_provincia,
    coalesce(productor_observaciones_nacional, 0) AS productor_observaciones_nacional,
    coalesce(fertilizantes_registros_provincia, 0) AS fertilizantes_registros_provincia,
    coalesce(fertilizantes_registros_nacional, 0) AS fertilizantes_registros_nacional,
    coalesce(fertilizantes_ingredientes_activos_provincia, 0) AS fertilizantes_ingredientes_activos_provincia)
  FROM flagged)"""


def _lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER w"


def _rolling(stat: str, size: int, y: str = TARGET) -> str:
    frame = f"OVER (w ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({y}) {frame} = {size} THEN {stat}({y}) {frame} END"


LAG_SQL = ",\n         ".join(
    [f"{_lag(TARGET, k)} AS target_lag_{k}" for k in (1, 2, 3, 6, 12)]
    + [f"{_rolling(f, n)} AS target_rolling_{a}_{n}" for n in (3, 6) for f, a in (("avg", "mean"), ("stddev_samp", "std"))]
    + [f"{_lag(TARGET, 1)} - {_lag(TARGET, k)} AS target_momentum_1_{k}" for k in (3, 6)]
)
EXOGENOUS_LAG_SQL = ",\n         ".join(
    [f"{_lag('precio_productor_usdkg_filled', k)} AS productor_lag_{k}" for k in (1, 3)]
    + [f"{_lag('fertilizantes_precio_promedio_filled', k)} AS fertilizantes_lag_{k}" for k in (1, 3)]
    + [f"{_lag(c, 1)} AS {c}_lag_1" for c in ("ipc_alimentos", "inflacion_mensual", "ibc", "ipm", "ipp_n")]
)
CALENDAR_SQL = """year(fecha) AS anio, month(fecha) AS mes_num, quarter(fecha) AS trimestre,
         sin(2 * pi() * month(fecha) / 12) AS mes_sin, cos(2 * pi() * month(fecha) / 12) AS mes_cos"""

WIDE = f"""{FILLED},
wide AS (
  SELECT *, {CALENDAR_SQL},
         {LAG_SQL},
         {EXOGENOUS_LAG_SQL}
  FROM filled WINDOW w AS ({ENTITY_SQL}))"""

COMPLETE_SQL = " AND ".join(f"{c} IS NOT NULL" for c in [TARGET, *FULL_FEATURES])

DATASET = f"""{WIDE},
dataset AS (SELECT * FROM wide WHERE {COMPLETE_SQL})"""


def holdout_sql(source: str = "dataset") -> str:
    """Rows with their entity's size, cutoff and split label."""
    return f"""
placed AS (
  SELECT *, row_number() OVER ({ENTITY_SQL}) AS place,
         count(*) OVER (PARTITION BY product_key, provincia_key) AS entity_rows
  FROM {source}),
cut AS (
  SELECT product_key, provincia_key, max(fecha) AS cutoff FROM placed
  WHERE place = greatest(1, least(CAST(floor(entity_rows * 0.8::DOUBLE) AS BIGINT), entity_rows - 1)) + 1 GROUP BY 1, 2),
split AS (
  SELECT placed.*, cutoff, CASE WHEN fecha < cutoff THEN 'train' ELSE 'test' END AS split
  FROM placed JOIN cut USING (product_key, provincia_key))"""


BOUNDS = """
dates AS (SELECT DISTINCT product_key, fecha FROM split WHERE split = 'train'),
chunks AS (
  SELECT product_key, fecha, CASE WHEN count(*) OVER p // 4 >= 6 THEN 3 ELSE 2 END AS windows,
         CASE WHEN count(*) OVER p // 4 >= 6 THEN ntile(4) OVER o ELSE ntile(3) OVER o END AS chunk
  FROM dates WINDOW p AS (PARTITION BY product_key), o AS (PARTITION BY product_key ORDER BY fecha)),
bounds AS (
  SELECT b.product_key, b.chunk - 1 AS fold, b.windows, a.val_end AS train_end, b.val_start, b.val_end
  FROM (SELECT product_key, windows, chunk, min(fecha) AS val_start, max(fecha) AS val_end FROM chunks GROUP BY 1, 2, 3) b
  JOIN (SELECT product_key, chunk, max(fecha) AS val_end FROM chunks GROUP BY 1, 2) a
    ON a.product_key = b.product_key AND a.chunk = b.chunk - 1)"""


def baseline_sql(source: str, name: str, extra: str = "") -> str:
    """Rows of all baselines and feature sets over `source`."""
    parts = []
    for model, column, guard in (
        ("naive", "target_lag_1", ""),
        ("seasonal_naive", "target_lag_12", f" AND entity_rows >= {MIN_ENTITY_ROWS}"),
        ("rolling_mean", "target_rolling_mean_3", ""),
    ):
        for fs, value in (("base", column), ("full", f"(1 - 0.1::DOUBLE) * {column} + 0.1::DOUBLE * precio_productor_usdkg_filled")):
            parts.append(
                f"""SELECT product_key AS product_id, producto, provincia, fecha{extra},
       target_precio_mercado_usdkg AS y_true, {value} AS y_pred, '{model}' AS model_name, '{fs}' AS feature_set
  FROM {source} WHERE {value} IS NOT NULL{guard}"""
            )
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


PREDICTIONS = f"""{DATASET},{holdout_sql()},
test_rows AS (SELECT * FROM split WHERE split = 'test'),
{baseline_sql('test_rows', 'predictions')}"""

OOF = f"""{PREDICTIONS},{BOUNDS},
fold_rows AS (
  SELECT s.*, fold, windows FROM split s JOIN bounds b
    ON b.product_key = s.product_key AND s.fecha BETWEEN b.val_start AND b.val_end
  WHERE split = 'train'),
{baseline_sql('fold_rows', 'oof', ', fold')}"""


def metrics_sql(source: str, by: str, order: str | None = None, entity: str = "product_id, provincia", date: str = "fecha") -> str:
    """Metric columns per group; direction per entity, or along `order` over the whole group."""
    window = f"PARTITION BY {by} ORDER BY {order}" if order else f"PARTITION BY {by}, {entity} ORDER BY {date}"
    return f"""
  SELECT {by}, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
         100 * avg(CASE WHEN y_true <> 0 THEN abs((y_true - y_pred) / y_true) END) AS mape,
         CASE WHEN count(*) < 2 THEN NULL
              WHEN var_pop(y_true) = 0 THEN CASE WHEN sum((y_true - y_pred) * (y_true - y_pred)) = 0 THEN 1 ELSE 0 END
              ELSE 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) END AS r2,
         avg(CASE WHEN y_before IS NOT NULL
                  THEN (sign(y_true - y_before) = sign(y_pred - p_before))::INT END) AS directional_accuracy,
         count(*) AS n_test
  FROM (SELECT *, lag(y_true) OVER d AS y_before, lag(y_pred) OVER d AS p_before
        FROM {source} WINDOW d AS ({window})) t
  GROUP BY {by}"""


SERIES_SQL = "product_id, model_name, feature_set"

FORECAST_STATE = """
  list(target_precio_mercado_usdkg) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS h,
  lag(fecha) OVER w AS history_date, lag(precio_productor_usdkg_filled) OVER w AS exog"""


def forecast_sql(state: str, name: str, keys: str) -> str:
    """Three recursive steps of every baseline from rows with `h`, `history_date` and `exog`."""
    start = {"naive": "{h}[len({h})]", "seasonal_naive": "CASE WHEN len({h}) >= 12 THEN {h}[len({h}) - 11] END",
             "rolling_mean": "list_avg({h}[greatest(len({h}) - 2, 1):])"}
    parts = []
    for model, rule in start.items():
        for fs in ("base", "full"):
            def step(h: str) -> str:
                value = rule.format(h=h)
                return value if fs == "base" else f"(1 - 0.1::DOUBLE) * {value} + 0.1::DOUBLE * exog"
            parts.append(f"""
  SELECT {keys}, '{model}' AS model_name, '{fs}' AS feature_set, unnest([1, 2, 3]) AS horizonte,
         unnest([p1, p2, p3]) AS y_pred, history_date
  FROM (SELECT *, {step('list_concat(h, [p1, p2])')} AS p3
        FROM (SELECT *, {step('list_concat(h, [p1])')} AS p2 FROM (SELECT *, {step('h')} AS p1 FROM {state}) a) b) c""")
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def query(ctes: str, final: str) -> str:
    return f"WITH {ctes.strip()}\n{final.strip()}"



"""Seasonal autoregressions of every product and province, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.common import BOUNDS, ENTITY_SQL, PREDICTIONS, SERIES_SQL, evaluation, metrics_sql, query, rounded, sql_round, sql_rounded
from panelmill.constants import MIN_ENTITY_ROWS, STABLE_MULTIPLE, TARGET
from panelmill.operators import metrics, seasonal
from panelmill.operators.forest import GRID, OFF_EDGE
from panelmill.operators.horizons import explode_forecasts, latest_state, origin_state
from panelmill.operators.seasonal import CANDIDATES, COEFFICIENTS, INPUTS, PRODUCER, STABLE_STEPS
from panelmill.operators.splits import assign_folds
from panelmill.operators.windows import ENTITY

METRICS = ["mae", "rmse", "mape", "r2", "directional_accuracy"]
FUTURE_STEPS = 6
_models: dict[tuple[str, str], object] = {}


def models(spark, sf):
    """Chosen models of the given tables; queries of a session share them."""
    place = (spark.sparkContext.applicationId, sf)
    if place not in _models:
        ev = evaluation(spark, sf)
        folded = assign_folds(ev.train, ev.bounds).withColumn("fold", F.col("fold").cast("int"))
        _models[place] = seasonal.fit_entities(ev.train, folded, ev.bounds)
    return _models[place]


def _test(spark, sf):
    rows = evaluation(spark, sf).split.where("split = 'test'")
    return seasonal.predicted(rows, models(spark, sf), ENTITY).withColumn("y_true", F.col(TARGET))


def arx_models(spark, sf):
    """The candidate of every entity, its validation error, and whether a better one was unstable."""
    return rounded(models(spark, sf).select(*ENTITY, "feature_set", "candidate", "validation_rmse_mean", "order_fallback_used"), 3)


def arx_per_entity(spark, sf):
    """One-step predictions of the test rows by each entity's own model."""
    return rounded(_test(spark, sf).select(*ENTITY, "fecha", "feature_set", "candidate", "y_true", "y_pred"), 3)


def arx_metrics(spark, sf):
    """Test metrics of the entity models, base and with the producer's price."""
    rows = _test(spark, sf).withColumn("model_name", F.lit("arx")).withColumnRenamed("product_key", "product_id")
    return rounded(metrics.regression_metrics(rows, metrics.SERIES), 3)


def arx_rolling_origins(spark, sf):
    """Recursive forecasts of one to three months from every test date."""
    state = origin_state(evaluation(spark, sf).split).where("split = 'test' and history_date is not null")
    made = seasonal.forecasts(state.withColumnRenamed("fecha", "fecha_origen").join(models(spark, sf), ENTITY), 3)
    rows = explode_forecasts(made, [*ENTITY, "feature_set", "fecha_origen"]).drop("model").where("y_pred is not null")
    return rounded(rows, 3)


def arx_future(spark, sf):
    """Six months beyond the data for every product and province."""
    state = latest_state(evaluation(spark, sf).split).join(models(spark, sf), ENTITY)
    rows = seasonal.forecasts(state, FUTURE_STEPS).select(*ENTITY, "feature_set", F.inline_outer("forecasts")).drop("model")
    return rounded(rows.where("y_pred is not null"), 3)


QUERIES = {f.__name__: f for f in (arx_models, arx_per_entity, arx_metrics, arx_rolling_origins, arx_future)}


def _fit_sql() -> str:
    """`r_candidates` (entity, fold, feature_set, candidate, coefficients) by normal equations."""
    values = {"y": TARGET, **INPUTS}
    names = sorted(values)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    whole = ", ".join(f"floor({c}::DOUBLE * {GRID}::DOUBLE + {OFF_EDGE}::DOUBLE)::BIGINT AS {v}" for v, c in values.items())
    sums = ", ".join([f"sum({v})::HUGEINT AS s_{v}" for v in values] + [f"sum({a}::HUGEINT * {b}::HUGEINT)::HUGEINT AS s_{a}_{b}" for a, b in pairs])

    def centred(i: str, j: str) -> str:
        i, j = sorted((i, j))
        return f"((n::HUGEINT * s_{i}_{j} - s_{i} * s_{j})::DOUBLE)"

    parts = []
    for feature_set, all_of in CANDIDATES.items():
        for k, inputs in enumerate(all_of):
            slopes, known = {"c_lag_1": "1.0::DOUBLE"}, "TRUE"
            if len(inputs) == 1:
                x = inputs[0]
                slopes, known = {x: f"{centred(x, 'y')} / {centred(x, x)}"}, f"{centred(x, x)} > 0 AND n >= {MIN_ENTITY_ROWS}"
            elif len(inputs) == 2:
                a, b = inputs
                det = f"({centred(a, a)} * {centred(b, b)} - {centred(a, b)} * {centred(a, b)})"
                slopes = {
                    a: f"({centred(a, 'y')} * {centred(b, b)} - {centred(b, 'y')} * {centred(a, b)}) / {det}",
                    b: f"({centred(b, 'y')} * {centred(a, a)} - {centred(a, 'y')} * {centred(a, b)}) / {det}",
                }
                known = f"{det} > 1e-9::DOUBLE * {centred(a, a)} * {centred(b, b)} AND n >= {MIN_ENTITY_ROWS}"
            mean = "0.0::DOUBLE"
            if inputs:
                mean = "s_y::DOUBLE" + "".join(f" - {x} * s_{x}::DOUBLE" for x in slopes)
                mean = f"({mean}) / n / {GRID}::DOUBLE"
            columns = ", ".join(f"{slopes.get(c, '0.0::DOUBLE')} AS {c}" for c in INPUTS)
            parts.append(f"""SELECT product_key, provincia_key, fold, '{feature_set}' AS feature_set, {k} AS candidate, {mean} AS c_0, {', '.join(INPUTS)}
  FROM (SELECT *, {columns} FROM r_sums WHERE {known}) q""")
    union = "\n  UNION ALL ".join(parts)
    return f"""
r_whole AS (SELECT product_key, provincia_key, fecha, {whole} FROM split WHERE split = 'train'),
r_every AS (SELECT *, 0 AS fold FROM r_whole UNION ALL
            SELECT w.*, fold::INTEGER FROM r_whole w JOIN bounds b ON b.product_key = w.product_key AND w.fecha <= b.train_end),
r_sums AS MATERIALIZED (SELECT product_key, provincia_key, fold, count(*) AS n, {sums} FROM r_every GROUP BY ALL),
r_candidates AS MATERIALIZED ({union})"""


def _step(values: dict[str, str]) -> str:
    terms = "".join(f" + CASE WHEN {c} = 0 THEN 0 ELSE {c} * {values[f]} END" for c, f in INPUTS.items())
    return f"c_0{terms}"


def _path(source: str, steps: int) -> str:
    """`source` (h, exog and coefficients) with p1 to p<steps>, each appended to the history."""
    values = {"target_lag_1": "h[len(h)]", "target_lag_12": "CASE WHEN len(h) >= 12 THEN h[len(h) - 11] END", PRODUCER: "exog"}
    out = source
    for k in range(1, steps + 1):
        out = f"(SELECT * REPLACE (list_append(h, p{k}) AS h) FROM (SELECT *, {_step(values)} AS p{k} FROM {out}) a{k})"
    return out


C = ", ".join(COEFFICIENTS)
AFTER = f"""list({TARGET}) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS h, lead(fecha) OVER w AS nxt, {PRODUCER} AS exog, fecha AS history_date"""
BEFORE = f"""list({TARGET}) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS h, lag({PRODUCER}) OVER w AS exog, lag(fecha) OVER w AS history_date"""
KEYED = "product_key, provincia_key, feature_set"
FIT = f"""{PREDICTIONS},{BOUNDS},{_fit_sql()},
r_folds AS (SELECT s.*, fold::INTEGER AS fold FROM split s JOIN bounds b ON b.product_key = s.product_key AND s.fecha BETWEEN b.val_start AND b.val_end
            WHERE split = 'train'),
r_rmse AS (SELECT {KEYED}, candidate, fold, sqrt(avg(power({TARGET} - ({_step({f: f for f in INPUTS.values()})}), 2))) AS e
           FROM r_folds JOIN r_candidates USING (product_key, provincia_key, fold) GROUP BY ALL),
r_score AS (SELECT {KEYED}, candidate, avg(e) AS validation_rmse_mean FROM r_rmse GROUP BY ALL),
r_end AS (SELECT * FROM (SELECT product_key, provincia_key, {AFTER} FROM split WHERE split = 'train' WINDOW w AS ({ENTITY_SQL})) q WHERE nxt IS NULL),
r_from AS (SELECT * FROM r_end JOIN (SELECT * EXCLUDE (fold) FROM r_candidates WHERE fold = 0) c USING (product_key, provincia_key)),
r_ahead AS (SELECT *, [{', '.join(f'p{k}' for k in range(1, STABLE_STEPS + 1))}] AS path, h[1:len(h) - {STABLE_STEPS}] AS past FROM {_path('r_from', STABLE_STEPS)} z),
r_ranked AS (SELECT *, len(list_filter(path, lambda p: p IS NULL OR p < 0 OR p > {STABLE_MULTIPLE}::DOUBLE * list_max(past))) = 0 AS stable
             FROM r_ahead LEFT JOIN r_score USING (product_key, provincia_key, feature_set, candidate)),
r_models AS MATERIALIZED (
  SELECT {KEYED}, candidate, {C}, validation_rmse_mean, best <> candidate AS order_fallback_used FROM (
    SELECT *, first_value(candidate) OVER (PARTITION BY {KEYED} ORDER BY validation_rmse_mean NULLS LAST, candidate) AS best FROM r_ranked) q
  QUALIFY row_number() OVER (PARTITION BY {KEYED} ORDER BY candidate > 0 AND NOT (stable AND validation_rmse_mean IS NOT NULL),
                             validation_rmse_mean NULLS LAST, candidate) = 1),
r_test AS (SELECT s.*, feature_set, candidate, {TARGET} AS y_true, {_step({f: f for f in INPUTS.values()})} AS y_pred
           FROM split s JOIN r_models USING (product_key, provincia_key) WHERE split = 'test')"""


def _horizons(name: str, state: str, steps: int, keep: str) -> str:
    path = ", ".join(f"p{k}" for k in range(1, steps + 1))
    return f"""
{name} AS (SELECT {KEYED}{keep}, history_date, unnest({list(range(1, steps + 1))}) AS horizonte, unnest([{path}]) AS y_pred
  FROM {_path(f'(SELECT * FROM {state} JOIN r_models USING (product_key, provincia_key))', steps)} z)"""


ORACLES = {
    "arx_models": query(FIT, f"SELECT {KEYED}, candidate, {sql_rounded('validation_rmse_mean', 3)} AS validation_rmse_mean, order_fallback_used FROM r_models"),
    "arx_per_entity": query(FIT, f"SELECT {KEYED}, fecha, candidate, {sql_round(['y_true', 'y_pred'], 3)} FROM r_test"),
    "arx_metrics": query(
        f"""{FIT}, r_rows AS (SELECT product_key AS product_id, provincia, fecha, 'arx' AS model_name, feature_set, y_true, y_pred FROM r_test),
m AS ({metrics_sql('r_rows', SERIES_SQL)})""",
        f"SELECT {SERIES_SQL}, {sql_round(METRICS, 3)}, n_test FROM m"),
    "arx_rolling_origins": query(
        f"""{FIT},
o_state AS (SELECT * FROM (SELECT product_key, provincia_key, fecha AS fecha_origen, split, {BEFORE} FROM split WINDOW w AS ({ENTITY_SQL})) q
            WHERE split = 'test' AND history_date IS NOT NULL),{_horizons('o', 'o_state', 3, ', fecha_origen')}""",
        f"""SELECT o.product_key, o.provincia_key, feature_set, fecha_origen, horizonte, r.fecha AS fecha_objetivo,
       {sql_rounded(f'r.{TARGET}', 3)} AS y_true, {sql_rounded('y_pred', 3)} AS y_pred
FROM o JOIN split r ON r.product_key = o.product_key AND r.provincia_key = o.provincia_key
 AND r.fecha = CAST(history_date + to_months(horizonte) AS DATE) WHERE y_pred IS NOT NULL"""),
    "arx_future": query(
        f"""{FIT},
l_state AS (SELECT * FROM (SELECT product_key, provincia_key, {AFTER} FROM split WINDOW w AS ({ENTITY_SQL})) q WHERE nxt IS NULL),
{_horizons('l', 'l_state', FUTURE_STEPS, '')}""",
        f"""SELECT {KEYED}, horizonte, CAST(history_date + to_months(horizonte) AS DATE) AS fecha_objetivo, {sql_rounded('y_pred', 3)} AS y_pred
FROM l WHERE y_pred IS NOT NULL"""),
}

"""Boosted trees of every product next to the baselines, and their SQL: fitting, scoring and forecasting.

SQL grows the same trees level by level from the same whole numbers, so results agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.catalog.common import (
    BOUNDS, ENTITY_SQL, PREDICTIONS, SERIES_SQL, dataset, evaluation, metrics_sql, query, rounded, sql_round, sql_rounded,
)
from panelmill.constants import (
    BASE_FEATURES, BLEND_WEIGHTS, CALENDAR_FEATURES, EXOGENOUS_FEATURES, EXOGENOUS_LAGS, FULL_FEATURES, TARGET, TARGET_LAGS,
)
from panelmill.catalog.models import OPERATIONAL, common_sql
from panelmill.functions.numbers import blend
from panelmill.operators import comparison, metrics
from panelmill.operators.forest import GRID, OFF_EDGE, TreeParams
from panelmill.operators.horizons import latest_state, recursive_forecast
from panelmill.operators.windows import ENTITY
from panelmill.plans.evaluation import baseline_predictor
from panelmill.plans.forests import ForestEvaluation

PARAMS = TreeParams()
PREFIXES = [PARAMS.rounds // 3, 2 * PARAMS.rounds // 3, PARAMS.rounds]
STORED_WEIGHT = 0.1
METRICS = ["mae", "rmse", "mape", "r2", "directional_accuracy"]
VALIDATION = ["validation_rmse_mean", "operational_rmse_mean"]

# Fitted models of this application, by folder of the given tables.
_forests: dict[tuple[str, str], ForestEvaluation] = {}


def forests(spark, sf) -> ForestEvaluation:
    place = (spark.sparkContext.applicationId, sf)
    if place not in _forests:
        _forests[place] = ForestEvaluation(evaluation(spark, sf), PARAMS)
    return _forests[place]


def forest_nodes(spark, sf):
    """The node table of all models: products, feature sets and folds."""
    nodes = forests(spark, sf).nodes
    names = F.array(*map(F.lit, FULL_FEATURES))
    return nodes.withColumn("feature", F.when(F.col("feature").isNotNull(), F.element_at(names, F.col("feature") + 1)))


def forest_metadata(spark, sf):
    """What is stored beside the node table for every model."""
    facts = forests(spark, sf).metadata().drop("params")
    return facts.withColumn("features", F.concat_ws(",", "features"))


def gbt_pooled(spark, sf):
    """One boosted model per product over all its provinces, scored on its holdout."""
    made = forests(spark, sf).predictions
    return rounded(made.select("product_id", "provincia", "fecha", "feature_set", "y_true", "y_pred"), 4)


def gbt_validation(spark, sf):
    """Out-of-fold predictions: every fold by the model of its training rows."""
    made = forests(spark, sf).oof
    return rounded(made.select("product_id", "provincia", "fecha", "fold", "feature_set", "y_true", "y_pred"), 4)


def gbt_grid(spark, sf):
    """Number of trees and blend weight scored on the expanding folds of each product, and the best of them."""
    scores = forests(spark, sf).grid(PREFIXES)
    order = F.struct("validation_rmse_mean", "validation_mae_mean", "trees", "blend_weight")
    best = F.min(order).over(Window.partitionBy("product_key", "feature_set"))
    return rounded(scores.withColumn("chosen", order == best), 4)


def feature_importance(spark, sf):
    """Share of the gain of every feature, for all products and both feature sets, in order of rank."""
    table = forests(spark, sf).importances().withColumnRenamed("product_key", "product_id").drop("gain")
    ranked = comparison.importance_table(rounded(table, 6))
    return ranked.orderBy("product_id", "feature_set", "importance_rank")


def stored_model_scores(spark, sf):
    """The stored models applied to the whole dataset and mixed with the last value."""
    ev = forests(spark, sf)
    rows = dataset(spark, sf).withColumn("fold", F.lit(0))
    made = ev.applied(rows, ["product_key", "provincia", "fecha", "target_lag_1"])
    value = blend(F.col("y_pred"), F.col("target_lag_1"), STORED_WEIGHT).alias("prediction")
    return rounded(made.select(F.col("product_key").alias("product_id"), "provincia", "fecha", "feature_set", value), 4)


def gbt_horizon_metrics(spark, sf):
    """Metrics per step of the trees' recursive forecasts from every test date."""
    return rounded(comparison.horizon_metrics(forests(spark, sf).horizons))


def gbt_operational_errors(spark, sf):
    """The trees' forecasts from the end of the last training fold, by the models of that fold."""
    made = forests(spark, sf).operational.where("y_pred is not null")
    return rounded(made.select("product_id", "provincia_key", "model_name", "feature_set", "horizonte", "fecha_objetivo", "y_true", "y_pred"), 4)


def fitted_metrics(spark, sf):
    """Test metrics with both validation errors, trees and baselines together."""
    return rounded(comparison.metrics_summary(forests(spark, sf).metrics))


def fitted_best_model(spark, sf):
    """Best `full` model per product among trees and baselines."""
    return rounded(comparison.best_models(forests(spark, sf).metrics))


def fitted_ablation(spark, sf):
    """What the exogenous features gain, for trees and baselines."""
    return rounded(comparison.ablation_summary(forests(spark, sf).metrics))


def fitted_common_window(spark, sf):
    """Trees and baselines on the test rows that all of them predict."""
    ev = forests(spark, sf)
    rows = ev.base.predictions.unionByName(ev.predictions).where("feature_set = 'full'")
    return rounded(comparison.common_window_comparison(rows))


def future_feature_rows(spark, sf):
    """All features of the three months after the data, with a rolling mean as the forecast that they grow by."""
    state = latest_state(dataset(spark, sf))
    made = recursive_forecast(state, {"rolling_mean/base": baseline_predictor("rolling_mean", "base")}, keep=FULL_FEATURES)
    rows = made.select(*ENTITY, F.inline_outer("forecasts")).drop("model")
    whole = {c: F.col(c).cast("double") for c in FULL_FEATURES}
    return rounded(rows.withColumns(whole), 4)


QUERIES = {
    f.__name__: f
    for f in (
        forest_nodes, forest_metadata, gbt_pooled, gbt_validation, gbt_grid, feature_importance, stored_model_scores,
        gbt_horizon_metrics, gbt_operational_errors, fitted_metrics, fitted_best_model, fitted_ablation, fitted_common_window,
        future_feature_rows,
    )
}


def _grid(x: str) -> str:
    return f"floor(({x})::DOUBLE * {GRID}::DOUBLE + {OFF_EDGE}::DOUBLE)::BIGINT"


def _list(values) -> str:
    return "[" + ", ".join(_grid(v) for v in values) + "]"


def _fit_sql(p: TreeParams) -> str:
    """`f_nodes` (m, tree, node, feature, threshold, gain, value, rows) of all models `f_models`."""
    def score(g: str, n: str) -> str:
        return f"({g})::DOUBLE * ({g})::DOUBLE / (({n})::DOUBLE + {p.penalty}::DOUBLE)"

    def leaf(g: str, n: str) -> str:
        return f"floor({p.step}::DOUBLE * (({g})::DOUBLE / (({n})::DOUBLE + {p.penalty}::DOUBLE)))::BIGINT"

    parts = [f"""
f_rows AS MATERIALIZED (SELECT product_key, fecha, {_grid(TARGET)} AS y, {_list(FULL_FEATURES)} AS x FROM split WHERE split = 'train'),
f_sets AS (SELECT 'base' AS feature_set, {len(BASE_FEATURES)} AS size UNION ALL SELECT 'full', {len(FULL_FEATURES)}),
f_folds AS (SELECT DISTINCT product_key, 0 AS fold, DATE '9999-12-31' AS train_end FROM f_rows
            UNION ALL SELECT product_key, fold::INTEGER, train_end FROM bounds),
f_m AS MATERIALIZED (
  SELECT row_number() OVER () AS id, dense_rank() OVER (ORDER BY product_key, feature_set, fold) AS m, product_key, feature_set, fold,
         x[1:size] AS x, y FROM f_rows JOIN f_folds USING (product_key), f_sets WHERE fecha <= train_end),
f_models AS MATERIALIZED (SELECT DISTINCT m, product_key, feature_set, fold FROM f_m),
f_long AS MATERIALIZED (SELECT id, m, unnest(x) AS v, unnest(range(len(x)))::INTEGER AS feature FROM f_m),
f_ranges AS MATERIALIZED (SELECT m, feature, min(v) AS low, max(v) - min(v) + 1 AS width FROM f_long GROUP BY ALL),
f_cells AS MATERIALIZED (
  SELECT id, l.m, l.feature, floor((v - low) * {p.bins} / width)::INTEGER AS b
  FROM f_long l JOIN f_ranges r ON r.m = l.m AND r.feature = l.feature),
f_start AS MATERIALIZED (SELECT m, floor(sum(y)::DOUBLE / count(*))::BIGINT AS value, count(*) AS rows FROM f_m GROUP BY 1),
g0 AS MATERIALIZED (SELECT id, f_m.m, 0 AS node, y - value AS g FROM f_m JOIN f_start ON f_start.m = f_m.m)"""]
    nodes = ["SELECT m, 0 AS tree, 0 AS node, NULL::INTEGER AS feature, NULL::INTEGER AS split, NULL::DOUBLE AS gain, value, rows FROM f_start"]
    blank = "NULL, NULL, NULL"
    for t in range(1, p.rounds + 1):
        placed = f"g{t - 1}"
        for level in range(1, p.depth + 1):
            s, nxt = f"s{t}_{level}", f"p{t}_{level}"
            parts.append(f"""
{s} AS MATERIALIZED (
  SELECT m, node, rows, best.feature AS feature, best.b AS split, -best.loss AS gain, best.nl AS left_rows, {leaf('g', 'rows')} AS value,
         {leaf('best.gl', 'best.nl')} AS lv, {leaf('g - best.gl', 'rows - best.nl')} AS rv
  FROM (SELECT m, node, max(g) AS g, max(n) AS rows, min(CASE WHEN nl >= {p.min_rows} AND n - nl >= {p.min_rows} AND gain > 0
                 THEN struct_pack(loss := -gain, feature := feature, b := b, gl := gl, nl := nl) END) AS best
        FROM (SELECT *, {score('gl', 'nl')} + {score('g - gl', 'n - nl')} - {score('g', 'n')} AS gain
              FROM (SELECT m, node, feature, b, (sum(g) OVER u)::BIGINT AS gl, (sum(n) OVER u)::BIGINT AS nl,
                           (sum(g) OVER f)::BIGINT AS g, (sum(n) OVER f)::BIGINT AS n
                    FROM (SELECT c.m, node, feature, b, sum(g)::BIGINT AS g, count(*) AS n FROM {placed} q JOIN f_cells c ON c.id = q.id GROUP BY ALL) h
                    WINDOW f AS (PARTITION BY m, node, feature),
                           u AS (PARTITION BY m, node, feature ORDER BY b ROWS UNBOUNDED PRECEDING)) w) x
        GROUP BY m, node) y),
{nxt} AS MATERIALIZED (
  SELECT q.id, q.m, q.g, CASE WHEN s.feature IS NULL THEN q.node ELSE 2 * q.node + 1 + (c.b > s.split)::INTEGER END AS node,
         CASE WHEN s.feature IS NULL THEN s.value WHEN c.b > s.split THEN rv ELSE lv END AS value
  FROM {placed} q JOIN {s} s ON s.m = q.m AND s.node = q.node LEFT JOIN f_cells c ON c.id = q.id AND c.feature = s.feature)""")
            nodes.append(f"SELECT m, {t}, node, feature, split, gain, NULL, rows FROM {s} WHERE feature IS NOT NULL")
            placed = nxt
        nodes.append(f"SELECT m, {t}, 2 * node + 1, {blank}, lv, left_rows FROM {s} WHERE feature IS NOT NULL")
        nodes.append(f"SELECT m, {t}, 2 * node + 2, {blank}, rv, rows - left_rows FROM {s} WHERE feature IS NOT NULL")
        nodes.append(f"SELECT m, {t}, node, {blank}, value, rows FROM {s} WHERE feature IS NULL")
        parts.append(f"\ng{t} AS MATERIALIZED (SELECT id, m, 0 AS node, g - value AS g FROM {placed})")
    union = "\n  UNION ALL ".join(nodes)
    parts.append(f"""
f_nodes AS MATERIALIZED (
  SELECT n.m, tree, node, n.feature, low + ceil((split + 1) * width / {p.bins})::BIGINT AS threshold, gain, value, rows
  FROM ({union}) n LEFT JOIN f_ranges r ON r.m = n.m AND r.feature = n.feature)""")
    return ",".join(parts)


def _walk_sql(source: str, name: str, depth: int) -> str:
    """`name` (rid, tree, value): the leaves that the rows of `source` (rid, m, fx) reach."""
    steps = [f"{name}_0 AS (SELECT rid, q.m, tree, 0 AS node, fx FROM {source} q JOIN (SELECT DISTINCT m, tree FROM f_nodes) t ON t.m = q.m)"]
    for k in range(depth):
        steps.append(f"""
{name}_{k + 1} AS (SELECT rid, w.m, w.tree, fx, CASE WHEN n.feature IS NULL THEN w.node
    ELSE 2 * w.node + 1 + (fx[n.feature + 1] >= n.threshold)::INTEGER END AS node
  FROM {name}_{k} w JOIN f_nodes n ON n.m = w.m AND n.tree = w.tree AND n.node = w.node)""")
    steps.append(f"""
{name} AS MATERIALIZED (SELECT rid, w.tree, value FROM {name}_{depth} w JOIN f_nodes n ON n.m = w.m AND n.tree = w.tree AND n.node = w.node)""")
    return ",".join(steps)


def _scored_sql(source: str, name: str, keep: str) -> str:
    """`name` (`keep`, feature_set, y_pred): rows of `source`, with fold, scored by the models of their fold."""
    return f"""
{name}_x AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, k.m, q.*, f_sets.feature_set AS set_name, {_list(FULL_FEATURES)}[1:size] AS fx
  FROM {source} q, f_sets JOIN f_models k ON k.feature_set = f_sets.feature_set WHERE k.product_key = q.product_key AND k.fold = q.fold),
{_walk_sql(f'{name}_x', f'{name}_w', PARAMS.depth)},
{name} AS MATERIALIZED (
  SELECT {keep}, set_name AS feature_set, y_pred
  FROM {name}_x JOIN (SELECT rid, sum(value)::BIGINT / {GRID}::DOUBLE AS y_pred FROM {name}_w GROUP BY 1) USING (rid))"""


CARRIED = ["provincia_id", *EXOGENOUS_FEATURES]


def _future(h: str, date: str, last: str) -> dict[str, str]:
    """SQL of every feature of a future month from the history list, the month and the last known values."""
    def lag(k: int) -> str:
        return f"CASE WHEN len({h}) >= {k} THEN {h}[len({h}) - {k - 1}] END"

    def tail(n: int) -> str:
        return f"{h}[greatest(len({h}) - {n - 1}, 1):]"

    out = {"mes_num": f"month({date})", "trimestre": f"quarter({date})", "mes_sin": f"sin(2 * pi() * month({date}) / 12)",
           "mes_cos": f"cos(2 * pi() * month({date}) / 12)"}
    out |= {c: f"{last}.{c}" for c in CARRIED} | {c: f"{last}.{base}" for c, (base, _) in EXOGENOUS_LAGS.items()}
    out |= {c: lag(k) for c, k in TARGET_LAGS.items()}
    for n in (3, 6):
        out[f"target_rolling_mean_{n}"] = f"list_avg({tail(n)})"
        out[f"target_rolling_std_{n}"] = f"CASE WHEN len({h}) > 1 THEN list_aggregate({tail(n)}, 'stddev_samp') ELSE 0 END"
        out[f"target_momentum_1_{n}"] = f"({lag(1)}) - ({lag(n)})"
    return out


LAST = "struct_pack(" + ", ".join(f"{c} := {c}" for c in CARRIED) + ")"


def _forecast_sql(state: str, name: str, keys: str) -> str:
    """Three recursive steps of the trees from rows with product_key, fold, h, history_date and last."""
    parts = [f"""
{name}_h0 AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, k.m, {keys}, q.product_key, f_sets.feature_set, size, h, history_date, last
  FROM {state} q, f_sets JOIN f_models k ON k.feature_set = f_sets.feature_set WHERE k.product_key = q.product_key AND k.fold = q.fold)"""]
    for step in (1, 2, 3):
        row = _future("h", f"(history_date + to_months({step}))", "last")
        parts.append(f"""
{name}_x{step} AS MATERIALIZED (
  SELECT * FROM (SELECT rid, m, size, {_list(row[c] for c in FULL_FEATURES)}[1:size] AS fx FROM {name}_h{step - 1}) q
  WHERE len(list_filter(fx, lambda v: v IS NOT NULL)) = size),
{_walk_sql(f'{name}_x{step}', f'{name}_w{step}', PARAMS.depth)},
{name}_p{step} AS MATERIALIZED (SELECT rid, sum(value)::BIGINT / {GRID}::DOUBLE AS p FROM {name}_w{step} GROUP BY 1),
{name}_h{step} AS MATERIALIZED (
  SELECT q.* REPLACE (list_append(h, p) AS h), p AS p{step} FROM {name}_h{step - 1} q LEFT JOIN {name}_p{step} USING (rid))""")
    parts.append(f"""
{name} AS MATERIALIZED (
  SELECT {keys}, product_key, 'trees' AS model_name, feature_set, history_date, unnest([1, 2, 3]) AS horizonte, unnest([p1, p2, p3]) AS y_pred
  FROM {name}_h3)""")
    return ",".join(parts)


FITTED = _fit_sql(PARAMS)
FIT = f"{PREDICTIONS},{BOUNDS},{FITTED}"
NAMED = "[" + ", ".join(f"'{c}'" for c in FULL_FEATURES) + "]"
TEST_PART = f"""
t_rows AS (SELECT *, 0 AS fold FROM split WHERE split = 'test'),
{_scored_sql('t_rows', 't_made', f'product_key AS product_id, producto, provincia, fecha, {TARGET} AS y_true')}"""
TESTED = f"{FIT},{TEST_PART}"
FOLD_PART = f"""
v_rows AS (SELECT s.*, fold::INTEGER AS fold FROM split s JOIN bounds b ON b.product_key = s.product_key AND s.fecha BETWEEN b.val_start AND b.val_end
           WHERE split = 'train'),
{_scored_sql('v_rows', 'v_made', f'product_key AS product_id, producto, provincia, fecha, fold, {TARGET} AS y_true')}"""
VALIDATED = f"{FIT},{FOLD_PART}"
WINDOW_ROWS = f"WINDOW w AS ({ENTITY_SQL})"
STATE = f"""list({TARGET}) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS h, lag(fecha) OVER w AS history_date,
         lag({LAST}) OVER w AS last"""
HORIZONS_SQL = f"""{FIT},
h_state AS (SELECT *, 0 AS fold_used, {STATE} FROM split {WINDOW_ROWS}),
h_first AS (SELECT product_key, provincia_key, provincia, fecha AS fecha_origen, h, history_date, last, 0 AS fold FROM h_state
            WHERE split = 'test' AND history_date IS NOT NULL),
{_forecast_sql('h_first', 'h_made', 'provincia_key, provincia, fecha_origen')},
horizons AS (SELECT m.product_key AS product_id, m.*, r.{TARGET} AS y_true FROM h_made m JOIN split r ON r.product_key = m.product_key
             AND r.provincia_key = m.provincia_key AND r.fecha = CAST(history_date + to_months(horizonte) AS DATE))"""
OPERATIONAL_PART = f"""
fop_last AS (SELECT * FROM bounds WHERE fold = windows),
fop_rows AS (SELECT s.*, l.train_end, l.fold::INTEGER AS fold FROM split s JOIN fop_last l USING (product_key) WHERE split = 'train' AND fecha <= val_end),
fop_state AS (SELECT *, {STATE} FROM fop_rows {WINDOW_ROWS}),
fop_first AS (SELECT product_key, provincia_key, fold, h, history_date, last FROM fop_state WHERE fecha > train_end AND history_date <= train_end),
{_forecast_sql('fop_first', 'fop_made', 'provincia_key')},
fop AS (SELECT m.product_key AS product_id, m.*, CAST(history_date + to_months(horizonte) AS DATE) AS fecha_objetivo, r.{TARGET} AS y_true
       FROM fop_made m JOIN fop_rows r ON r.product_key = m.product_key AND r.provincia_key = m.provincia_key
        AND r.fecha = CAST(history_date + to_months(horizonte) AS DATE) AND r.fecha > train_end)"""
OPERATIONAL_FIT = f"{FIT},{OPERATIONAL_PART}"
ROWS = "product_id, producto, provincia, fecha"
EVERY = f"""{OPERATIONAL},{FITTED},{TEST_PART},{FOLD_PART},{OPERATIONAL_PART},
every_test AS (SELECT {ROWS}, y_true, y_pred, model_name, feature_set FROM predictions
               UNION ALL SELECT {ROWS}, y_true, y_pred, 'trees', feature_set FROM t_made),
every_oof AS (SELECT product_id, fold, y_true, y_pred, model_name, feature_set FROM oof
              UNION ALL SELECT product_id, fold, y_true, y_pred, 'trees', feature_set FROM v_made),
every_op AS (SELECT product_id, y_true, y_pred, model_name, feature_set FROM op WHERE y_pred IS NOT NULL
             UNION ALL SELECT product_id, y_true, y_pred, model_name, feature_set FROM fop WHERE y_pred IS NOT NULL),
e_test AS ({metrics_sql('every_test', SERIES_SQL)}),
e_val AS (SELECT {SERIES_SQL}, avg(e) AS validation_rmse_mean FROM (
  SELECT {SERIES_SQL}, fold, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS e FROM every_oof GROUP BY ALL) v GROUP BY ALL),
e_op AS (SELECT {SERIES_SQL}, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS operational_rmse_mean FROM every_op GROUP BY ALL),
metrics AS (SELECT * FROM e_test LEFT JOIN e_val USING ({SERIES_SQL}) LEFT JOIN e_op USING ({SERIES_SQL}))"""
WEIGHTS = "[" + ", ".join(f"{w}::DOUBLE" for w in BLEND_WEIGHTS) + "]"
GRID_SQL = f"""{VALIDATED},
c_sums AS (SELECT rid, trees, sum(value)::BIGINT / {GRID}::DOUBLE AS raw FROM v_made_w, (SELECT unnest({PREFIXES}) AS trees) t WHERE tree <= trees GROUP BY ALL),
c_rows AS (SELECT product_key, set_name AS feature_set, fold, trees, w AS blend_weight,
                  {TARGET} - ((1 - w) * raw + w * target_lag_1) AS e
           FROM c_sums JOIN v_made_x USING (rid), (SELECT unnest({WEIGHTS}) AS w) z),
c_folds AS (SELECT product_key, feature_set, trees, blend_weight, fold, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM c_rows GROUP BY ALL),
c AS (SELECT product_key, feature_set, trees, blend_weight, avg(rmse) AS r, avg(mae) AS a, count(*) AS n_windows FROM c_folds GROUP BY ALL)"""
END_ROWS = f"""{PREDICTIONS},
e_state AS (SELECT product_key, provincia_key, fecha AS history_date, lead(fecha) OVER w AS nxt, {LAST} AS last,
                   list({TARGET}) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS h FROM dataset {WINDOW_ROWS}),
e_path AS (SELECT *, list_append(h1, p2) AS h2 FROM (SELECT *, list_avg(h1[greatest(len(h1) - 2, 1):]) AS p2 FROM (
             SELECT *, list_append(h, p1) AS h1 FROM (SELECT *, list_avg(h[greatest(len(h) - 2, 1):]) AS p1 FROM e_state WHERE nxt IS NULL) a) b) c)"""


def _end_step(step: int) -> str:
    h = ("h", "h1", "h2")[step - 1]
    row = _future(h, f"(history_date + to_months({step}))", "last")
    columns = ", ".join(f"{sql_rounded(f'({row[c]})::DOUBLE', 4)} AS {c}" for c in FULL_FEATURES)
    value = f"list_avg({h}[greatest(len({h}) - 2, 1):])"
    return f"""SELECT product_key, provincia_key, {step} AS horizonte, CAST(history_date + to_months({step}) AS DATE) AS fecha_objetivo,
       {sql_rounded(value, 4)} AS y_pred, {columns} FROM e_path"""


ORACLES = {
    "forest_nodes": query(FIT, f"""SELECT product_key, feature_set, fold, tree, node, {NAMED}[feature + 1] AS feature, threshold, gain, value, rows
FROM f_nodes JOIN f_models USING (m)"""),
    "forest_metadata": query(FIT, f"""SELECT product_key, feature_set, fold, max(tree) AS trees, count(feature) AS splits,
       max(rows) FILTER (tree = 0) AS training_rows, max(value) FILTER (tree = 0) AS start_value, 'trees' AS model_name, '{TARGET}' AS target,
       array_to_string(CASE feature_set WHEN 'base' THEN {NAMED}[1:{len(BASE_FEATURES)}] ELSE {NAMED} END, ',') AS features
FROM f_nodes JOIN f_models USING (m) GROUP BY product_key, feature_set, fold"""),
    "gbt_pooled": query(TESTED, f"SELECT product_id, provincia, fecha, feature_set, {sql_round(['y_true', 'y_pred'], 4)} FROM t_made"),
    "gbt_validation": query(VALIDATED, f"SELECT product_id, provincia, fecha, fold, feature_set, {sql_round(['y_true', 'y_pred'], 4)} FROM v_made"),
    "gbt_grid": query(GRID_SQL, f"""SELECT product_key, feature_set, trees, {sql_rounded('blend_weight', 4)} AS blend_weight,
       {sql_rounded('r', 4)} AS validation_rmse_mean, n_windows, {sql_rounded('a', 4)} AS validation_mae_mean,
       row_number() OVER (PARTITION BY product_key, feature_set ORDER BY r, a, trees, blend_weight) = 1 AS chosen FROM c"""),
    "feature_importance": query(FIT, f"""SELECT product_id, feature_set, feature, importance,
       row_number() OVER (PARTITION BY product_id, feature_set ORDER BY importance DESC, position) AS importance_rank
FROM (SELECT product_id, feature_set, position, {NAMED}[position + 1] AS feature,
             {sql_rounded('CASE WHEN sum(gain) OVER k > 0 THEN gain / sum(gain) OVER k ELSE 0 END', 6)} AS importance
      FROM (SELECT k.product_key AS product_id, k.feature_set, position, coalesce(sum(gain) FILTER (n.feature = position), 0) AS gain
            FROM f_models k JOIN f_sets USING (feature_set) JOIN f_nodes n ON n.m = k.m,
                 (SELECT unnest(range({len(FULL_FEATURES)})) AS position) z
            WHERE k.fold = 0 AND position < size GROUP BY ALL) g WINDOW k AS (PARTITION BY product_id, feature_set)) i"""),
    "stored_model_scores": query(
        f"""{FIT},
a_rows AS (SELECT *, 0 AS fold FROM dataset),
{_scored_sql('a_rows', 'a_made', 'product_key AS product_id, provincia, fecha, target_lag_1')}""",
        f"""SELECT product_id, provincia, fecha, feature_set,
       {sql_rounded(f'(1 - {STORED_WEIGHT}::DOUBLE) * y_pred + {STORED_WEIGHT}::DOUBLE * target_lag_1', 4)} AS prediction FROM a_made"""),
    "gbt_horizon_metrics": query(
        f"""{HORIZONS_SQL}, m AS ({metrics_sql('(SELECT * FROM horizons WHERE y_pred IS NOT NULL) q', SERIES_SQL + ', horizonte', entity='provincia', date='fecha_origen')})""",
        f"SELECT {SERIES_SQL}, horizonte, {sql_round(METRICS)}, n_test FROM m"),
    "gbt_operational_errors": query(
        OPERATIONAL_FIT, f"""SELECT product_id, provincia_key, model_name, feature_set, horizonte, fecha_objetivo, {sql_round(['y_true', 'y_pred'], 4)}
FROM fop WHERE y_pred IS NOT NULL"""),
    "fitted_metrics": query(EVERY, f"SELECT {SERIES_SQL}, {sql_round(METRICS + VALIDATION)}, n_test FROM metrics"),
    "fitted_best_model": query(EVERY, f"""SELECT {SERIES_SQL}, {sql_round(METRICS + VALIDATION)}, n_test,
       'operational_rmse_mean' AS selection_metric FROM metrics WHERE feature_set = 'full'
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY operational_rmse_mean NULLS LAST, rmse, mae, model_name) = 1"""),
    "fitted_ablation": query(EVERY, f"""SELECT product_id, model_name,
       {", ".join(sql_rounded(f"b.{m}") + f" AS {m}_base, " + sql_rounded(f"f.{m}") + f" AS {m}_full" for m in ("rmse", "mae", "mape"))},
       {sql_rounded('b.rmse - f.rmse')} AS delta_rmse_full_vs_base, {sql_rounded('(b.rmse - f.rmse) / b.rmse * 100')} AS pct_improvement_full_vs_base
FROM (SELECT * FROM metrics WHERE feature_set = 'base') b JOIN (SELECT * FROM metrics WHERE feature_set = 'full') f
  USING (product_id, model_name)"""),
    "fitted_common_window": query(
        f"""{TESTED},
every_full AS (SELECT {ROWS}, y_true, y_pred, model_name, feature_set FROM predictions WHERE feature_set = 'full'
               UNION ALL SELECT {ROWS}, y_true, y_pred, 'trees', feature_set FROM t_made WHERE feature_set = 'full'),{common_sql('every_full', 'matched')},
m AS ({metrics_sql('matched', SERIES_SQL)})""",
        f"SELECT {SERIES_SQL}, {sql_round(METRICS)}, n_test FROM m"),
    "future_feature_rows": query(END_ROWS, "\nUNION ALL ".join(_end_step(k) for k in (1, 2, 3))),
}

"""Predictions of the fitting-free models, and every table that compares models."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.common import (
    FORECAST_STATE, OOF, PREDICTIONS, SERIES_SQL, evaluation, forecast_sql, metrics_sql, query,
    rounded, sql_round, sql_rounded,
)
from panelmill.constants import REPLICAS
from panelmill.operators import bootstrap, comparison, metrics
from panelmill.operators.monitoring import attach_predictions, performance_report as performance
from panelmill.operators.summaries import mean_across_entities, top_rows

METRICS = ["mae", "rmse", "mape", "r2", "directional_accuracy"]
ROW = ["product_id", "producto", "provincia", "fecha", "model_name", "feature_set"]


def _full(ev):
    return ev.predictions.where("feature_set = 'full'")


def baseline_predictions(spark, sf):
    return rounded(evaluation(spark, sf).predictions.select(*ROW, "y_true", "y_pred"), 4)


def validation_predictions(spark, sf):
    return rounded(evaluation(spark, sf).oof.select(*ROW, "fold", "y_true", "y_pred"), 4)


def regression_metrics(spark, sf):
    return rounded(metrics.regression_metrics(evaluation(spark, sf).predictions, metrics.SERIES))


def regression_metrics_row_order(spark, sf):
    scored = metrics.regression_metrics(
        evaluation(spark, sf).predictions, metrics.SERIES, row_order=["fecha", "provincia"]
    )
    return rounded(scored.select(*metrics.SERIES, "directional_accuracy", "n_test"))


def entity_metrics(spark, sf):
    return rounded(metrics.entity_metrics(evaluation(spark, sf).predictions))


def metrics_summary(spark, sf):
    return rounded(comparison.metrics_summary(evaluation(spark, sf).metrics))


def best_model(spark, sf):
    return rounded(comparison.best_models(evaluation(spark, sf).metrics))


def ablation_summary(spark, sf):
    return rounded(comparison.ablation_summary(evaluation(spark, sf).metrics))


def common_window(spark, sf):
    return rounded(comparison.common_window_comparison(_full(evaluation(spark, sf))))


def common_window_manifest(spark, sf):
    manifest = comparison.common_window_manifest(_full(evaluation(spark, sf)))
    return manifest.select(
        "product_id", F.array_join("models_available", "|").alias("models"), "common_test_rows",
        *[F.try_element_at("dropped_rows_by_model", F.lit(m)).alias(f"dropped_{m}")
          for m in ("naive", "rolling_mean", "seasonal_naive")],
        F.coalesce("warning", F.lit("")).alias("warning"),
    )


def common_validation_window(spark, sf):
    return rounded(comparison.common_validation_window(evaluation(spark, sf).oof.where("feature_set = 'full'")))


def rows_lost_to_common_window(spark, sf):
    full = _full(evaluation(spark, sf))
    lost = comparison.dropped_rows(full, comparison.common_keys(full), comparison.ROW_KEY)
    return lost.select("product_id", "provincia", "fecha", "model_name")


def block_bootstrap_ci(spark, sf):
    return rounded(bootstrap.rmse_intervals(_full(evaluation(spark, sf)), REPLICAS), 4)


def pairwise_significance(spark, sf):
    return rounded(bootstrap.pairwise_significance(_full(evaluation(spark, sf)), REPLICAS), 4)


def ablation_significance(spark, sf):
    return rounded(bootstrap.ablation_significance(evaluation(spark, sf).predictions, REPLICAS), 4)


def recursive_horizons(spark, sf):
    made = evaluation(spark, sf).horizons.where("y_pred is not null")
    return rounded(made.select(
        "product_id", "provincia", "fecha_origen", "model_name", "feature_set", "horizonte", "fecha_objetivo",
        "y_true", "y_pred",
    ), 4)


def horizon_metrics(spark, sf):
    return rounded(comparison.horizon_metrics(evaluation(spark, sf).horizons))


def operational_errors(spark, sf):
    errors = evaluation(spark, sf).operational.where("y_pred is not null")
    return rounded(errors.select("product_id", "provincia_key", "model_name", "feature_set", "horizonte",
                                 "fecha_objetivo", "y_true", "y_pred"), 4)


def prediction_chart_series(spark, sf):
    return rounded(mean_across_entities(evaluation(spark, sf).predictions))


def _scored(ev):
    one = ev.predictions.where("model_name = 'rolling_mean' and feature_set = 'full'")
    features = ev.dataset.withColumnRenamed("product_key", "product_id")
    return attach_predictions(features, one, ["product_id", "provincia", "fecha"])


def predictions_attached(spark, sf):
    return rounded(_scored(evaluation(spark, sf)).select(
        "product_id", "provincia", "fecha", "target_lag_1", "target", "prediction"), 4)


def performance_report(spark, sf):
    """Earlier against later test months of every model."""
    rows = evaluation(spark, sf).predictions
    return rounded(performance(
        rows.where("fecha < date '2001-01-01'"), rows.where("fecha >= date '2001-01-01'"), metrics.SERIES
    ))


def top_errors(spark, sf):
    """The 15 largest absolute errors."""
    rows = evaluation(spark, sf).predictions.withColumn("error", F.abs(F.col("y_true") - F.col("y_pred")))
    order = [F.desc("error"), *[F.asc(c) for c in ROW]]
    return rounded(top_rows(rows.select(*ROW, "error"), order, 15), 4)


def stable_forecasts(spark, sf):
    """Forecast paths that pass and fail the sanity check, per product and model."""
    from panelmill.functions.numbers import stable_forecast
    from panelmill.operators.horizons import origin_state, recursive_forecast
    from panelmill.plans.evaluation import baseline_predictors

    ev = evaluation(spark, sf)
    origins = origin_state(ev.split).where("split = 'test' and history_date is not null")
    predictors = {k: v for k, v in baseline_predictors().items() if k in ("naive/full", "rolling_mean/full")}
    made = recursive_forecast(origins, predictors)
    rows = made.select("product_key", "history", F.inline("forecasts")).groupBy("product_key", "model", "horizonte")
    verdict = stable_forecast(F.array("y_pred"), F.col("history"))
    return rows.agg(F.count_if(verdict).alias("stable"), F.count_if(~verdict).alias("unstable"))


QUERIES = {
    f.__name__: f
    for f in (
        baseline_predictions, validation_predictions, regression_metrics, regression_metrics_row_order, entity_metrics,
        metrics_summary, best_model, ablation_summary, common_window, common_window_manifest, common_validation_window,
        rows_lost_to_common_window, block_bootstrap_ci, pairwise_significance, ablation_significance,
        recursive_horizons, horizon_metrics, operational_errors, prediction_chart_series, predictions_attached,
        performance_report, top_errors, stable_forecasts,
    )
}

FULL_PREDICTIONS = f"{PREDICTIONS},\nfull_predictions AS (SELECT * FROM predictions WHERE feature_set = 'full')"


def common_sql(source: str, name: str) -> str:
    return f"""
{name}_keys AS (
  SELECT k.product_id, producto, provincia, fecha
  FROM (SELECT product_id, producto, provincia, fecha, count(DISTINCT model_name) AS present FROM {source} GROUP BY ALL) k
  JOIN (SELECT product_id, count(DISTINCT model_name) AS needed FROM {source} GROUP BY ALL) n USING (product_id)
  WHERE present = needed AND needed >= 2),
{name} AS (SELECT s.* FROM {source} s JOIN {name}_keys USING (product_id, producto, provincia, fecha))"""


COMMON = f"{FULL_PREDICTIONS},{common_sql('full_predictions', 'matched')}"

OPERATIONAL = f"""{OOF},
op_last AS (SELECT * FROM bounds WHERE fold = windows),
op_rows AS (SELECT s.*, l.train_end FROM split s JOIN op_last l USING (product_key) WHERE split = 'train' AND fecha <= val_end),
op_state AS (SELECT *, {FORECAST_STATE} FROM op_rows WINDOW w AS (PARTITION BY product_key, provincia_key ORDER BY fecha)),
op_first AS (SELECT product_key AS product_id, provincia_key, h, history_date, exog FROM op_state
             WHERE fecha > train_end AND history_date <= train_end),
{forecast_sql('op_first', 'op_made', 'product_id, provincia_key')},
op AS (SELECT m.*, CAST(history_date + to_months(horizonte) AS DATE) AS fecha_objetivo,
              r.target_precio_mercado_usdkg AS y_true
       FROM op_made m JOIN op_rows r ON r.product_key = product_id AND r.provincia_key = m.provincia_key
        AND r.fecha = CAST(history_date + to_months(horizonte) AS DATE) AND r.fecha > train_end)"""

ALL_METRICS = f"""{OPERATIONAL},
test_metrics AS ({metrics_sql('predictions', SERIES_SQL)}),
val_metrics AS (SELECT {SERIES_SQL}, avg(e) AS validation_rmse_mean FROM (
  SELECT {SERIES_SQL}, fold, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS e FROM oof GROUP BY ALL) v GROUP BY ALL),
op_metrics AS (SELECT {SERIES_SQL}, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS operational_rmse_mean FROM op GROUP BY ALL),
metrics AS (SELECT * FROM test_metrics LEFT JOIN val_metrics USING ({SERIES_SQL}) LEFT JOIN op_metrics USING ({SERIES_SQL}))"""

HORIZON = f"""{PREDICTIONS},
h_state AS (SELECT *, {FORECAST_STATE} FROM split WINDOW w AS (PARTITION BY product_key, provincia_key ORDER BY fecha)),
h_first AS (SELECT product_key AS product_id, provincia_key, provincia, fecha AS fecha_origen, h, history_date, exog
            FROM h_state WHERE split = 'test' AND history_date IS NOT NULL),
{forecast_sql('h_first', 'h_made', 'product_id, provincia_key, provincia, fecha_origen')},
horizons AS (SELECT m.*, r.fecha AS fecha_objetivo, r.target_precio_mercado_usdkg AS y_true
       FROM h_made m JOIN split r ON r.product_key = product_id AND r.provincia_key = m.provincia_key
        AND r.fecha = CAST(history_date + to_months(horizonte) AS DATE))"""


def _bootstrap(source: str, series: str) -> str:
    """Replica RMSE of every series by resampled rows, with the same hash draws."""
    return f"""
pos AS (SELECT product_id, provincia, {series} AS series, fecha, y_true, y_pred,
               row_number() OVER (PARTITION BY product_id, provincia, {series} ORDER BY fecha) - 1 AS i,
               count(*) OVER (PARTITION BY product_id, provincia, {series}) AS n FROM {source}),
ents AS (SELECT DISTINCT product_id, provincia, n, CASE WHEN n <= 4 THEN 1 ELSE 4 END AS len FROM pos),
slots AS (SELECT *, unnest(range(CAST(ceil(n / len) AS BIGINT))) AS slot FROM ents),
reps AS (SELECT s.*, r.replica FROM slots s, (SELECT unnest(range(1, {REPLICAS + 1})) AS replica) r),
draws AS (SELECT *, CAST(('0x' || substr(md5('42|' || replica || '|' || product_id || '|' || provincia || '|' || slot), 1, 8))
                      AS BIGINT) % (n - len + 1) AS start FROM reps),
picked AS (SELECT product_id, provincia, replica, start + unnest(range(least(len, n - slot * len))) AS i FROM draws),
boot AS (SELECT p.product_id, series, replica, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse
         FROM picked k JOIN pos p ON p.product_id = k.product_id AND p.provincia = k.provincia AND p.i = k.i GROUP BY ALL),
point AS (SELECT product_id, series, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, count(*) AS n FROM pos GROUP BY 1, 2)"""


PAIRED = """
deltas AS (SELECT a.product_id, a.series AS sa, b.series AS sb, a.rmse - b.rmse AS delta
           FROM boot a JOIN boot b ON a.product_id = b.product_id AND a.replica = b.replica AND a.series < b.series),
pd AS (SELECT a.product_id, a.series AS sa, b.series AS sb, a.rmse - b.rmse AS point, a.n
       FROM point a JOIN point b ON a.product_id = b.product_id AND a.series < b.series),
stats AS (SELECT product_id, sa, sb, max(n) AS n, max(point) AS point,
                 2 * max(point) - quantile_cont(delta, 0.975) AS lower, 2 * max(point) - quantile_cont(delta, 0.025) AS upper,
                 least(1.0, 2 * least(avg((2 * point - delta <= 0)::INT), avg((2 * point - delta >= 0)::INT))) AS p
          FROM deltas JOIN pd USING (product_id, sa, sb) GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (ORDER BY p, product_id, sa, sb) AS r, count(*) OVER () AS m FROM stats),
holm AS (SELECT *, min((p <= (1::DOUBLE - 0.95::DOUBLE) / (m - r + 1))::INT) OVER (ORDER BY r) = 1 AS significant_holm FROM ranked)"""

VERDICT = f"""{sql_rounded('lower', 4)} AS delta_ci_lower, {sql_rounded('upper', 4)} AS delta_ci_upper,
       NOT (lower <= 0 AND upper >= 0) AS significant_95, {sql_rounded('p', 4)} AS p_value_bootstrap, significant_holm"""
MEAN_ERRORS = ", avg(y_pred - y_true) AS mean_error, stddev_samp(y_pred - y_true) AS std_error"


def _report(which: str, condition: str) -> str:
    base = metrics_sql(f"(SELECT * FROM predictions WHERE {condition}) q", SERIES_SQL)
    return base.replace("count(*) AS n_test", f"count(*) AS n_test{MEAN_ERRORS}, '{which}' AS which")


ORACLES = {
    "baseline_predictions": query(PREDICTIONS, f"SELECT {', '.join(ROW)}, {sql_round(['y_true', 'y_pred'], 4)} FROM predictions"),
    "validation_predictions": query(OOF, f"SELECT {', '.join(ROW)}, fold, {sql_round(['y_true', 'y_pred'], 4)} FROM oof"),
    "regression_metrics": query(
        f"{PREDICTIONS}, m AS ({metrics_sql('predictions', SERIES_SQL)})", f"SELECT {SERIES_SQL}, {sql_round(METRICS)}, n_test FROM m"
    ),
    "regression_metrics_row_order": query(
        f"{PREDICTIONS}, m AS ({metrics_sql('predictions', SERIES_SQL, 'fecha, provincia')})",
        f"SELECT {SERIES_SQL}, {sql_round(['directional_accuracy'])}, n_test FROM m",
    ),
    "entity_metrics": query(
        f"{PREDICTIONS}, m AS ({metrics_sql('predictions', SERIES_SQL + ', provincia', entity='product_id')})",
        f"SELECT {SERIES_SQL}, provincia, {sql_round(METRICS)}, n_test, n_test < 5 AS exploratorio FROM m",
    ),
    "metrics_summary": query(
        ALL_METRICS,
        f"SELECT {SERIES_SQL}, {sql_round(METRICS + ['validation_rmse_mean', 'operational_rmse_mean'])}, n_test FROM metrics",
    ),
    "best_model": query(
        ALL_METRICS,
        f"""SELECT {SERIES_SQL}, {sql_round(METRICS + ['validation_rmse_mean', 'operational_rmse_mean'])}, n_test,
       'operational_rmse_mean' AS selection_metric FROM metrics WHERE feature_set = 'full'
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY operational_rmse_mean NULLS LAST, rmse, mae, model_name) = 1""",
    ),
    "ablation_summary": query(
        ALL_METRICS,
        f"""SELECT product_id, model_name, {", ".join(sql_rounded(f"b.{m}") + f" AS {m}_base, " + sql_rounded(f"f.{m}") + f" AS {m}_full" for m in ("rmse", "mae", "mape"))},
       {sql_rounded('b.rmse - f.rmse')} AS delta_rmse_full_vs_base, {sql_rounded('(b.rmse - f.rmse) / b.rmse * 100')} AS pct_improvement_full_vs_base
FROM (SELECT * FROM metrics WHERE feature_set = 'base') b JOIN (SELECT * FROM metrics WHERE feature_set = 'full') f
  USING (product_id, model_name)""",
    ),
    "common_window": query(
        f"{COMMON}, m AS ({metrics_sql('matched', SERIES_SQL)})", f"SELECT {SERIES_SQL}, {sql_round(METRICS)}, n_test FROM m"
    ),
    "common_window_manifest": query(
        COMMON,
        """SELECT product_id, string_agg(model_name, '|' ORDER BY model_name) AS models, max(k) AS common_test_rows,
       max(lost) FILTER (model_name = 'naive') AS dropped_naive,
       max(lost) FILTER (model_name = 'rolling_mean') AS dropped_rolling_mean,
       max(lost) FILTER (model_name = 'seasonal_naive') AS dropped_seasonal_naive, '' AS warning
FROM (SELECT f.product_id, model_name, k, count(*) - k AS lost FROM full_predictions f
      JOIN (SELECT product_id, count(*) AS k FROM matched_keys GROUP BY 1) c USING (product_id) GROUP BY 1, 2, 3) t
GROUP BY 1""",
    ),
    "common_validation_window": query(
        f"""{OOF}, full_oof AS (SELECT * FROM oof WHERE feature_set = 'full'),{common_sql('full_oof', 'matched')},
m AS ({metrics_sql('matched', SERIES_SQL)})""",
        f"""SELECT {SERIES_SQL}, {sql_rounded('rmse')} AS validation_rmse_common, {sql_rounded('mae')} AS validation_mae_common,
       {sql_rounded('mape')} AS validation_mape_common, n_test AS n FROM m""",
    ),
    "rows_lost_to_common_window": query(
        COMMON,
        """SELECT product_id, provincia, fecha, model_name FROM full_predictions f
WHERE NOT EXISTS (SELECT 1 FROM matched_keys k WHERE k.product_id = f.product_id AND k.provincia = f.provincia
                  AND k.fecha = f.fecha AND k.producto = f.producto)""",
    ),
    "block_bootstrap_ci": query(
        f"{COMMON},{_bootstrap('matched', 'model_name')}",
        f"""SELECT product_id, series AS model_name, p.n, {sql_rounded('p.rmse', 4)} AS rmse_bootstrap_mean,
       {sql_rounded('greatest(0, 2 * p.rmse - quantile_cont(b.rmse, 0.975))', 4)} AS rmse_ci_lower,
       {sql_rounded('2 * p.rmse - quantile_cont(b.rmse, 0.025)', 4)} AS rmse_ci_upper,
       0.95::DOUBLE AS confidence, 4 AS block_size_months
FROM boot b JOIN point p USING (product_id, series) GROUP BY product_id, series, p.n, p.rmse""",
    ),
    "pairwise_significance": query(
        f"{COMMON},{_bootstrap('matched', 'model_name')},{PAIRED}",
        f"SELECT product_id, sa AS model_a, sb AS model_b, n, {sql_rounded('point', 4)} AS delta_rmse_a_minus_b, {VERDICT} FROM holm",
    ),
    "ablation_significance": query(
        f"""{PREDICTIONS},
both_sets AS (SELECT product_id || '|' || model_name AS product_id, provincia, fecha, feature_set, y_true, y_pred FROM predictions
  QUALIFY count(*) OVER (PARTITION BY product_id, model_name, provincia, fecha) = 2),
{_bootstrap('both_sets', 'feature_set')},{PAIRED}""",
        f"""SELECT split_part(product_id, '|', 1) AS product_id, split_part(product_id, '|', 2) AS model_name, n,
       {sql_rounded('point', 4)} AS delta_rmse_base_minus_full, {VERDICT} FROM holm""",
    ),
    "recursive_horizons": query(
        HORIZON,
        f"""SELECT product_id, provincia, fecha_origen, model_name, feature_set, horizonte, fecha_objetivo,
       {sql_round(['y_true', 'y_pred'], 4)} FROM horizons WHERE y_pred IS NOT NULL""",
    ),
    "horizon_metrics": query(
        f"{HORIZON}, m AS ({metrics_sql('(SELECT * FROM horizons WHERE y_pred IS NOT NULL) q', SERIES_SQL + ', horizonte', entity='provincia', date='fecha_origen')})",
        f"SELECT {SERIES_SQL}, horizonte, {sql_round(METRICS)}, n_test FROM m",
    ),
    "operational_errors": query(
        OPERATIONAL,
        f"""SELECT product_id, provincia_key, model_name, feature_set, horizonte, fecha_objetivo, {sql_round(['y_true', 'y_pred'], 4)}
FROM op WHERE y_pred IS NOT NULL""",
    ),
    "prediction_chart_series": query(
        PREDICTIONS,
        f"""SELECT product_id, fecha, model_name, feature_set, {sql_rounded('avg(y_true)')} AS y_true, {sql_rounded('avg(y_pred)')} AS y_pred
FROM predictions GROUP BY ALL""",
    ),
    "predictions_attached": query(
        PREDICTIONS,
        f"""SELECT product_id, p.provincia, p.fecha, {sql_rounded('target_lag_1', 4)} AS target_lag_1,
       {sql_rounded('y_true', 4)} AS target, {sql_rounded('y_pred', 4)} AS prediction
FROM predictions p JOIN dataset d ON d.product_key = product_id AND d.provincia = p.provincia AND d.fecha = p.fecha
WHERE model_name = 'rolling_mean' AND feature_set = 'full'""",
    ),
    "performance_report": query(
        f"""{PREDICTIONS}, r AS ({_report('reference', "fecha < DATE '2001-01-01'")}),
c AS ({_report('current', "fecha >= DATE '2001-01-01'")})""",
        f"""SELECT {SERIES_SQL}, {sql_round(METRICS + ['mean_error', 'std_error'])}, n_test, which FROM (
  SELECT * FROM c WHERE n_test >= 5 UNION ALL
  SELECT r.* FROM r JOIN (SELECT {SERIES_SQL} FROM c WHERE n_test >= 5) k USING ({SERIES_SQL})) u""",
    ),
    "top_errors": query(
        PREDICTIONS,
        f"""SELECT {', '.join(ROW)}, {sql_rounded('abs(y_true - y_pred)', 4)} AS error FROM predictions
ORDER BY abs(y_true - y_pred) DESC, {', '.join(ROW)} LIMIT 15""",
    ),
    "stable_forecasts": query(
        HORIZON,
        """SELECT product_id AS product_key, model_name || '/full' AS model, horizonte,
       count(*) FILTER (y_pred >= 0 AND y_pred <= 5 * list_max(h)) AS stable,
       count(*) FILTER (NOT (y_pred >= 0 AND y_pred <= 5 * list_max(h))) AS unstable
FROM h_made m JOIN h_first f USING (product_id, provincia_key, fecha_origen)
WHERE feature_set = 'full' AND model_name IN ('naive', 'rolling_mean') GROUP BY 1, 2, 3""",
    ),
}

"""Selectors that fail, ordered sinks, stored metrics and the status of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelmill.catalog.common import PREDICTIONS, SERIES_SQL, SHARED, evaluation, inputs, metrics_sql, query, rounded, sql_round, sql_rounded
from panelmill.catalog.models import ALL_METRICS, HORIZON, METRICS
from panelmill.constants import TARGET
from panelmill.functions.text import same_name
from panelmill.operators import comparison, metrics
from panelmill.operators.contracts import select_or_fail
from panelmill.operators.summaries import top_rows
from panelmill.plans.runner import Runner
from panelmill.session import scratch_dir
from panelmill.sources import store

PROVINCE = "nation_19"
ORDER = ["fecha", "provincia", "product_id", "model_name", "feature_set"]
FAILING = "no such province"


def _place(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _province(rows, name):
    return select_or_fail(rows, same_name(F.col("provincia"), name), f"{FAILING}: {name}")


def province_rows(spark, sf):
    """Market rows of one province, named in any case; an unknown one fails the query."""
    rows = _province(inputs(spark, sf).market, PROVINCE)
    return rounded(rows.select("product_key", "provincia", "fecha", TARGET), 4)


def ordered_predictions(spark, sf):
    """Predictions written as globally sorted files, with each row's position in file order."""
    path = _place(spark, "ordered")
    store.write_ordered(evaluation(spark, sf).predictions, path, ORDER)
    return rounded(store.read_ordered(spark, path).select(*ORDER, "y_pred", "position"), 4)


def predictions_tail(spark, sf):
    """The twenty latest predictions of the naive model, kept by a bounded heap per task."""
    rows = evaluation(spark, sf).predictions.where("model_name = 'naive' and feature_set = 'base'")
    order = [F.desc("fecha"), F.asc("provincia"), F.asc("product_id")]
    return rounded(top_rows(rows.select("product_id", "provincia", "fecha", "y_true", "y_pred"), order, 20), 4)


def stored_metrics(spark, sf):
    """Test metrics and metrics per step, stored apart and read back as one table."""
    ev, path = evaluation(spark, sf), _place(spark, "metrics")
    store.write_artifact(ev.metrics, path, "test")
    store.write_artifact(comparison.horizon_metrics(ev.horizons), path, "horizons")
    kept = store.scan_artifacts(spark, path)
    return rounded(kept.select("kind", *metrics.SERIES, "horizonte", "rmse", "validation_rmse_mean", "n_test"))


def run_status(spark, sf):
    """Outcome of three stages, of which one asks for a province that is not there."""
    ev = evaluation(spark, sf)
    run = Runner(spark, _place(spark, "run"))
    run.run("all", "baselines", "full", lambda: ev.predictions.where("feature_set = 'full'"))
    run.run("all", "baselines", "none", lambda: _province(ev.predictions, "nowhere"))
    run.run("all", "baselines", "base", lambda: ev.predictions.where("feature_set = 'base'"))
    return run.status().drop("seconds")


QUERIES = {f.__name__: f for f in (province_rows, ordered_predictions, predictions_tail, stored_metrics, run_status)}

ORACLES = {
    "province_rows": query(
        SHARED, f"SELECT product_key, provincia, fecha, {sql_rounded(TARGET, 4)} AS {TARGET} FROM market_panel WHERE lower(provincia) = '{PROVINCE}'"),
    "ordered_predictions": query(
        PREDICTIONS, f"SELECT {', '.join(ORDER)}, {sql_rounded('y_pred', 4)} AS y_pred, row_number() OVER (ORDER BY {', '.join(ORDER)}) AS position FROM predictions"),
    "predictions_tail": query(PREDICTIONS, f"""SELECT product_id, provincia, fecha, {sql_round(['y_true', 'y_pred'], 4)} FROM predictions
WHERE model_name = 'naive' AND feature_set = 'base' ORDER BY fecha DESC, provincia, product_id LIMIT 20"""),
    "stored_metrics": query(
        f"""{ALL_METRICS}, {HORIZON[HORIZON.index('h_state AS'):]},
hm AS ({metrics_sql('(SELECT * FROM horizons WHERE y_pred IS NOT NULL) q', SERIES_SQL + ', horizonte', entity='provincia', date='fecha_origen')})""",
        f"""SELECT 'test' AS kind, {SERIES_SQL}, NULL::INTEGER AS horizonte, {sql_rounded('rmse')} AS rmse,
       {sql_rounded('validation_rmse_mean')} AS validation_rmse_mean, n_test FROM metrics
UNION ALL SELECT 'horizons', {SERIES_SQL}, horizonte, {sql_rounded('rmse')}, NULL, n_test FROM hm"""),
    "run_status": query(PREDICTIONS, f"""SELECT 'all' AS product_id, 'baselines' AS model_name, feature_set, 'ok' AS status, count(*) AS rows, NULL::VARCHAR AS error
FROM predictions GROUP BY feature_set
UNION ALL SELECT 'all', 'baselines', 'none', 'error', NULL, '{FAILING}: nowhere'"""),
}

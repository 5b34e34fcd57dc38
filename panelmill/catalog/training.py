"""Fitted models. These have no SQL counterpart; the tests compare them with direct solutions."""

from __future__ import annotations

from panelmill.catalog.common import evaluation, rounded
from panelmill.operators import comparison, metrics
from panelmill.plans.training import fit_sequences

def sequence_scores(spark, sf):
    return rounded(fit_sequences(evaluation(spark, sf).split).scores, 3)


def sequence_regression(spark, sf):
    made = fit_sequences(evaluation(spark, sf).split).predictions
    return rounded(metrics.regression_metrics(made, metrics.SERIES), 3)


def sequence_common_window(spark, sf):
    """Validation window the sequence model shares with the baselines."""
    fitted = fit_sequences(evaluation(spark, sf).split).oof.drop("fold")
    baselines = evaluation(spark, sf).oof.where("feature_set = 'base'").select(*fitted.columns)
    return rounded(comparison.common_validation_window(fitted.unionByName(baselines)), 3)


QUERIES = {f.__name__: f for f in (sequence_scores, sequence_regression, sequence_common_window)}
ORACLES: dict[str, str] = {}

"""Train, evaluate and compare: from the feature dataset to the published tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.constants import MIN_ENTITY_ROWS, TARGET
from panelmill.functions.numbers import blend
from panelmill.operators.horizons import Predictor, operational_forecasts, rolling_origin_forecasts
from panelmill.operators.metrics import SERIES, mean_of_window_rmse, pooled_rmse, regression_metrics
from panelmill.operators.splits import assign_folds, fold_bounds, holdout

# Models that need no fitting: (feature the prediction starts from, needs a long history)
BASELINES = {
    "naive": ("target_lag_1", False),
    "seasonal_naive": ("target_lag_12", True),
    "rolling_mean": ("target_rolling_mean_3", False),
}
EXOGENOUS_SHARE = 0.1
EXOGENOUS_COLUMN = "precio_productor_usdkg_filled"


def baseline_predictor(name: str, feature_set: str) -> Predictor:
    """One-step predictor of a baseline; `full` mixes in the producer price."""
    start, _ = BASELINES[name]

    def predict(features: dict[str, Column]) -> Column:
        share = EXOGENOUS_SHARE if feature_set == "full" else 0.0
        return blend(features[start], features[EXOGENOUS_COLUMN], share)

    return predict


def baseline_predictors() -> dict[str, Predictor]:
    return {f"{m}/{s}": baseline_predictor(m, s) for m in BASELINES for s in ("base", "full")}


def split_label(df: DataFrame, label: str = "model") -> DataFrame:
    """`model/feature_set` labels as two columns."""
    parts = F.split(label, "/")
    return df.withColumns({"model_name": parts[0], "feature_set": parts[1]}).drop(label)


def baseline_rows(df: DataFrame, min_rows: int = MIN_ENTITY_ROWS) -> DataFrame:
    """A prediction per row, baseline and feature set; `entity_rows` is the entity's history."""
    features = {c: F.col(c) for c in df.columns}
    entries = []
    for label, predictor in baseline_predictors().items():
        name = label.split("/")[0]
        usable = F.col("entity_rows") >= min_rows if BASELINES[name][1] else F.lit(True)
        entries.append(F.struct(F.lit(label).alias("model"), F.when(usable, predictor(features)).alias("y_pred")))
    kept = [c for c in ("fold", "windows") if c in df.columns]
    rows = df.select(
        F.col("product_key").alias("product_id"), "producto", "provincia", "fecha", *kept,
        F.col(TARGET).alias("y_true"), F.inline(F.array(*entries)),
    )
    return split_label(rows).where("y_pred is not null")


@dataclass
class Evaluation:
    """Lazy result tables of the baselines on one feature dataset."""

    dataset: DataFrame
    min_rows: int = MIN_ENTITY_ROWS

    @cached_property
    def split(self) -> DataFrame:
        rows = F.count(F.lit(1)).over(Window.partitionBy("product_key", "provincia_key"))
        return holdout(self.dataset.withColumn("entity_rows", rows))

    @cached_property
    def train(self) -> DataFrame:
        return self.split.where("split = 'train'")

    @cached_property
    def bounds(self) -> DataFrame:
        return fold_bounds(self.train)

    @cached_property
    def predictions(self) -> DataFrame:
        return baseline_rows(self.split.where("split = 'test'"), self.min_rows)

    @cached_property
    def oof(self) -> DataFrame:
        return baseline_rows(assign_folds(self.train, self.bounds), self.min_rows)

    @cached_property
    def operational(self) -> DataFrame:
        made = operational_forecasts(self.train, self.bounds, baseline_predictors())
        return split_label(made).withColumnRenamed("product_key", "product_id")

    @cached_property
    def horizons(self) -> DataFrame:
        made = rolling_origin_forecasts(
            self.split, baseline_predictors(), ["product_key", "provincia_key", "provincia"]
        )
        return split_label(made).withColumnRenamed("product_key", "product_id")

    @cached_property
    def metrics(self) -> DataFrame:
        """Test metrics of every (product, model, feature set) with both validation errors."""
        return joined_metrics(self.predictions, self.oof, self.operational)


def joined_metrics(predictions: DataFrame, oof: DataFrame, operational: DataFrame) -> DataFrame:
    """Test metrics of every series in `predictions`, with its errors on folds and from their last end."""
    test = regression_metrics(predictions, SERIES)
    validation = mean_of_window_rmse(oof, SERIES, ["fold"], "validation_rmse_mean")
    pooled = pooled_rmse(operational.where("y_pred is not null"), SERIES, "operational_rmse_mean")
    return test.join(validation, SERIES, "left").join(pooled, SERIES, "left")

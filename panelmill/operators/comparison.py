"""Tables that compare models: best model, ablation, common windows, importances, run status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.metrics import regression_metrics
from panelmill.operators.windows import best_row, first_occurrence_rank

ROW_KEY = ["product_id", "producto", "provincia", "fecha"]


def metrics_summary(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("product_id", "feature_set", "rmse", "mae", "model_name")


def best_models(metrics: DataFrame) -> DataFrame:
    """Best `full` model per product by operational RMSE; by plain RMSE when none has one."""
    full = metrics.where(F.col("feature_set") == "full")
    known = F.count("operational_rmse_mean").over(Window.partitionBy("product_id")) > 0
    ordered = (
        full.withColumn("selection_metric", F.when(known, "operational_rmse_mean").otherwise("rmse"))
        .withColumn("first__", F.when(known, F.col("operational_rmse_mean")).otherwise(F.col("rmse")))
        .withColumn("second__", F.when(known, F.col("rmse")).otherwise(F.col("mae")))
        .withColumn("third__", F.when(known, F.col("mae")).otherwise(F.col("mape")))
    )
    best = best_row(ordered, ["product_id"], ["first__", "second__", "third__", "model_name"])
    return best.drop("first__", "second__", "third__")


def ablation_summary(metrics: DataFrame) -> DataFrame:
    """Error of base and full side by side, with the absolute and relative gain of full."""
    wide = (
        metrics.groupBy("product_id", "model_name")
        .pivot("feature_set", ["base", "full"])
        .agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("mape").alias("mape"))
    )
    names = {f"{s}_{m}": f"{m}_{s}" for s in ("base", "full") for m in ("rmse", "mae", "mape")}
    gain = F.col("rmse_base") - F.col("rmse_full")
    return wide.withColumnsRenamed(names).withColumns(
        {
            "delta_rmse_full_vs_base": gain,
            "pct_improvement_full_vs_base": F.when(F.col("rmse_base") != 0, gain / F.col("rmse_base") * 100),
        }
    )


def product_models(predictions: DataFrame) -> DataFrame:
    """Names of the models each product has rows for."""
    models = predictions.select("product_id", "model_name").distinct()
    return models.groupBy("product_id").agg(F.array_sort(F.collect_list("model_name")).alias("models"))


def common_keys(predictions: DataFrame, key: list[str] = ROW_KEY) -> DataFrame:
    """Rows predicted by every model of the product, when it has at least two models.

    One aggregation over the keys replaces a chain of joins between models.
    """
    by_key = predictions.groupBy(*key).agg(F.count_distinct("model_name").alias("present"))
    needed = product_models(predictions).select("product_id", F.size("models").alias("needed"))
    return by_key.join(needed.where("needed >= 2"), "product_id").where("present = needed").select(*key)


def common_window(predictions: DataFrame, key: list[str] = ROW_KEY) -> DataFrame:
    """Predictions restricted to the rows all models of the product have in common."""
    return predictions.join(common_keys(predictions, key), key, "left_semi")


def common_window_comparison(predictions: DataFrame) -> DataFrame:
    return regression_metrics(common_window(predictions), ["product_id", "model_name", "feature_set"])


def common_window_manifest(predictions: DataFrame, rows_name: str = "common_test_rows") -> DataFrame:
    """Per product: models, size of the common window, rows each model loses, and a warning."""
    common = common_keys(predictions).withColumn("kept", F.lit(1))
    marked = predictions.join(common, ROW_KEY, "left")
    per_model = marked.groupBy("product_id", "model_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count("kept").alias("matched")
    )
    size = common.groupBy("product_id").agg(F.count(F.lit(1)).alias(rows_name))
    entries = F.array_sort(F.collect_list(F.struct("model_name", (F.col("rows") - F.col("matched")).alias("lost"))))
    manifest = per_model.groupBy("product_id").agg(entries.alias("entries")).join(size, "product_id", "left")
    few = F.size("entries") < 2
    return manifest.select(
        "product_id",
        F.transform("entries", lambda e: e["model_name"]).alias("models_available"),
        F.coalesce(rows_name, F.lit(0)).alias(rows_name),
        F.when(few, F.create_map().cast("map<string,bigint>"))
        .otherwise(F.map_from_entries("entries"))
        .alias("dropped_rows_by_model"),
        F.when(few, F.lit("fewer than 2 models with predictions")).alias("warning"),
    )


def common_validation_window(oof: DataFrame) -> DataFrame:
    """Error of each model on the validation rows all models share."""
    scored = common_window_comparison(oof)
    return scored.select(
        "product_id",
        "model_name",
        "feature_set",
        F.col("rmse").alias("validation_rmse_common"),
        F.col("mae").alias("validation_mae_common"),
        F.col("mape").alias("validation_mape_common"),
        F.col("n_test").alias("n"),
    )


def dropped_rows(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `left` whose key is absent from `right`."""
    return left.join(right, key, "left_anti")


def horizon_metrics(forecasts: DataFrame) -> DataFrame:
    """Metrics per product, model and step over the forecasts that are defined."""
    defined = forecasts.where(F.col("y_pred").isNotNull() & ~F.isnan("y_pred"))
    by = ["product_id", "model_name", "feature_set", "horizonte"]
    return regression_metrics(defined.withColumnRenamed("fecha_origen", "fecha"), by)


def importance_table(importances: DataFrame) -> DataFrame:
    """Ranked importances from (product_id, feature_set, position, feature, importance)."""
    rank = first_occurrence_rank(["product_id", "feature_set"], "importance", "position")
    return importances.withColumn("importance_rank", rank).drop("position")


def run_status(spark, outcomes: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Small table with the outcome of each training call."""
    schema = "product_id string, model_name string, feature_set string, status string, error string"
    return spark.createDataFrame(outcomes, schema)

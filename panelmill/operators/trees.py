"""Boosted trees with Spark ML: one model over all rows it is given, for panels whose trees have to grow large.

`forest` fits a model per product, set and fold together; this is the library's learner, one fit a call.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.constants import BLEND_WEIGHTS, SEED, TARGET, TREE_GRID
from panelmill.functions.numbers import blend
from panelmill.operators.metrics import candidate_score

LAG = "target_lag_1"
POOL = 4


def tree_pipeline(features: list[str], params: dict, target: str = TARGET) -> Pipeline:
    trees = GBTRegressor(
        featuresCol="features", labelCol=target, predictionCol="raw", seed=SEED, maxIter=params["trees"],
        maxDepth=params["depth"], stepSize=params["step"], subsamplingRate=params.get("subsample", 1.0),
        checkpointInterval=10,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees])


def fit_trees(train: DataFrame, features: list[str], params: dict, target: str = TARGET) -> PipelineModel:
    """Fits on the rows of `train`; growing the trees is distributed over its partitions."""
    return tree_pipeline(features, params, target).fit(train.select(*dict.fromkeys([*features, target])))


def score(model: PipelineModel, rows: DataFrame, weight: float | Column = 0.0) -> DataFrame:
    """Adds `y_pred_raw` and `y_pred`, the prediction mixed with the last value."""
    scored = model.transform(rows).drop("features").withColumnRenamed("raw", "y_pred_raw")
    return scored.withColumn("y_pred", blend(F.col("y_pred_raw"), F.col(LAG), weight))


def fit_each(parts: dict, fit) -> dict:
    """Independent fits from a small thread pool; the jobs share the cluster."""
    with ThreadPoolExecutor(POOL) as pool:
        return dict(zip(parts, pool.map(fit, parts.values()), strict=True))


def union_all(parts: list[DataFrame]) -> DataFrame:
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined


def grid_scores(
    dev: DataFrame, bounds: DataFrame, features: list[str], by: list[str], grid: list[dict] = TREE_GRID,
    weights: list[float] = BLEND_WEIGHTS, target: str = TARGET,
) -> DataFrame:
    """Validation error of every (parameters, blend weight) pair over the expanding folds.

    A fold's model is fitted once per parameter set; the weights only re-score its rows.
    `bounds` must be the same for all rows of `dev` (one product, or one calendar).
    """
    folds = [r.asDict() for r in bounds.orderBy("fold").collect()]
    parts = {(i, f["fold"]): (params, f) for i, params in enumerate(grid) for f in folds}

    def validated(part):
        params, fold = part
        fitted = fit_trees(dev.where(F.col("fecha") <= F.lit(fold["train_end"])), features, params, target)
        return score(fitted, dev.where(F.col("fecha").between(F.lit(fold["val_start"]), F.lit(fold["val_end"]))))

    scored = fit_each(parts, validated)
    rows = union_all([
        df.select(*by, F.lit(i).alias("candidate"), F.lit(fold).alias("fold"), F.col(target).alias("y"), "y_pred_raw", LAG)
        for (i, fold), df in scored.items()
    ])
    weighted = rows.withColumn("blend_weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    error = F.col("y") - blend(F.col("y_pred_raw"), F.col(LAG), F.col("blend_weight"))
    keys = [*by, "candidate", "blend_weight"]
    per_fold = weighted.groupBy(*keys, "fold").agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae")
    )
    mae = per_fold.groupBy(*keys).agg(F.avg("mae").alias("validation_mae_mean"))
    return candidate_score(per_fold, keys).join(mae, keys)


def best_candidate(scores: DataFrame, by: list[str]) -> DataFrame:
    """Lowest error per group; ties by absolute error, then by position in the grid."""
    order = F.struct("validation_rmse_mean", "validation_mae_mean", "candidate", "blend_weight")
    usable = scores.where("validation_rmse_mean is not null")
    best = F.min(order).alias("best")
    return (usable.groupBy(*by).agg(best) if by else usable.agg(best)).select(*by, "best.*")


def importances(model: PipelineModel, spark: SparkSession, features: list[str], product: str, feature_set: str) -> DataFrame:
    """(product_id, feature_set, position, feature, importance) of a fitted model."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(product, feature_set, i, f, float(v)) for i, (f, v) in enumerate(zip(features, values, strict=True))]
    schema = "product_id string, feature_set string, position int, feature string, importance double"
    return spark.createDataFrame(rows, schema)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def predict_stored(path: str, rows: DataFrame, weight: float = 0.0, province: str | None = None) -> DataFrame:
    """Scores rows with a stored model, for one province (in any case) or all."""
    from panelmill.functions.text import same_name

    chosen = rows if province is None else rows.where(same_name(F.col("provincia"), province))
    scored = score(PipelineModel.load(path), chosen, weight)
    return scored.select("fecha", "producto", "provincia", F.col("y_pred").alias("prediction"))

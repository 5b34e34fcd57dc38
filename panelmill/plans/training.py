"""Fitted models on the feature dataset: sequence regressions, boosted trees, entity models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.constants import BASE_FEATURES, SEQUENCE_LENGTHS, TARGET
from panelmill.operators.ridge import cross_sums, expanding_sums, linear_prediction, solve
from panelmill.operators.splits import date_chunks
from panelmill.operators.windows import ENTITY, entity_window
from panelmill.session import materialise

PENALTIES = [0.1, 1.0]
SEQUENCE_MODEL = "sequence_linear"


@dataclass
class SequenceFit:
    """Result tables of the sequence regressions."""

    scores: DataFrame
    best: DataFrame
    predictions: DataFrame
    oof: DataFrame


def _sequence_rows(split: DataFrame, features: list[str], lengths: list[int]) -> DataFrame:
    """One row per entity row and window length that its history allows, current row included."""
    longest = max(lengths)
    frame = entity_window().rowsBetween(-(longest - 1), 0)
    values = F.array(*[F.col(c).cast("double") for c in features])
    windowed = split.withColumn("steps", F.collect_list(values).over(frame))
    rows = windowed.withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths])))
    return rows.where(F.size("steps") >= F.col("length")).select(
        *ENTITY, "producto", "provincia", "fecha", "split", "chunk", "windows", "length",
        F.flatten(F.slice("steps", F.size("steps") - F.col("length") + 1, F.col("length"))).alias("x"),
        F.col(TARGET).cast("double").alias("y_true"),
    )


def _fold_ranges(train: DataFrame, features: list[str]) -> DataFrame:
    """Minimum and range of each feature over all training rows up to every chunk."""
    stats = [f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for f, n in ((F.min, "a"), (F.max, "b"))]
    per_chunk = train.groupBy("product_key", "chunk").agg(*stats)
    upto = Window.partitionBy("product_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    low = [F.min(f"a{i}").over(upto) for i in range(len(features))]
    high = [F.max(f"b{i}").over(upto) for i in range(len(features))]
    return per_chunk.select(
        "product_key", "chunk", F.array(*low).alias("low1"),
        F.array(*[h - a for a, h in zip(low, high, strict=True)]).alias("spread1"),
    )


def fit_sequences(
    split: DataFrame, features: list[str] = BASE_FEATURES, lengths: list[int] = SEQUENCE_LENGTHS,
    penalties: list[float] = PENALTIES, feature_set: str = "base",
) -> SequenceFit:
    """Ridge regressions on flattened windows for all products, lengths, penalties and folds.

    Every candidate of every fold comes from one pass over the training rows.
    """
    train = split.where("split = 'train'")
    chunks = date_chunks(train)
    last_chunk = chunks.groupBy("product_key").agg(F.max("windows").alias("windows__"))
    marked = split.join(chunks, ["product_key", "fecha"], "left").join(last_chunk, "product_key")
    # a test row may share its month with training rows of other provinces
    marked = marked.withColumns(
        {
            "chunk": F.when(F.col("split") == "train", F.col("chunk")),
            "windows": F.col("windows__"),
        }
    ).drop("windows__")
    rows = materialise(_sequence_rows(marked, features, lengths), "sequences")
    dev = rows.where("split = 'train'")

    sums = cross_sums(dev, ["product_key", "length", "chunk"], "x", "y_true")
    states = expanding_sums(sums, ["product_key", "length"])
    ranges = _fold_ranges(marked.where("split = 'train'"), features)

    def tiled(values: str) -> Column:
        return F.flatten(F.array_repeat(values, F.col("length")))

    ready = states.join(ranges, ["product_key", "chunk"]).withColumns({"low": tiled("low1"), "spread": tiled("spread1")})
    betas = materialise(solve(ready, ["product_key", "length", "chunk"], penalties), "betas")

    keys = ["product_key", "length", "fold", "penalty"]
    fold_betas = betas.withColumnRenamed("chunk", "fold")
    validation = dev.where("chunk > 1").withColumn("fold", F.col("chunk") - 1).join(fold_betas, keys[:3])
    validated = validation.withColumn("y_pred", linear_prediction(F.col("x"), F.col("beta")))
    error = F.col("y_true") - F.col("y_pred")
    per_fold = validated.groupBy(*keys).agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    scores = per_fold.groupBy("product_key", "length", "penalty").agg(
        F.avg("rmse").alias("validation_rmse_mean"), F.count(F.lit(1)).alias("n_windows")
    )
    scores = materialise(scores, "sequence-scores")
    pick = F.min(F.struct("validation_rmse_mean", "length", "penalty")).alias("best")
    best = scores.groupBy("product_key").agg(pick).select("product_key", "best.*")

    chosen = best.select("product_key", "length", "penalty")
    final = betas.join(chosen, ["product_key", "length", "penalty"]).join(
        last_chunk.withColumn("chunk", F.col("windows__") + 1), ["product_key", "chunk"]
    )
    test = rows.where("split = 'test'").drop("chunk").join(final.drop("chunk", "windows__", "penalty"), ["product_key", "length"])
    scored = test.withColumn("y_pred", linear_prediction(F.col("x"), F.col("beta")))

    def labelled(df: DataFrame, *extra: str) -> DataFrame:
        return df.select(
            F.col("product_key").alias("product_id"), "producto", "provincia", "fecha", *extra, "y_true", "y_pred",
            F.lit(SEQUENCE_MODEL).alias("model_name"), F.lit(feature_set).alias("feature_set"),
        )

    oof = validated.join(chosen, ["product_key", "length", "penalty"], "left_semi")
    return SequenceFit(scores, best, labelled(scored), labelled(oof, "fold"))

"""Boosted trees of all products, feature sets and folds: fitted once, stored as a node table, applied anywhere."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.constants import BLEND_WEIGHTS, FEATURES_BY_SET, TARGET
from panelmill.functions.numbers import blend
from panelmill.functions.text import once
from panelmill.operators import forest
from panelmill.operators.forest import TreeParams, forest_prediction, on_grid
from panelmill.operators.horizons import Predictor, operational_forecasts, rolling_origin_forecasts
from panelmill.operators.metrics import candidate_score
from panelmill.operators.splits import assign_folds
from panelmill.plans.evaluation import Evaluation, joined_metrics, split_label
from panelmill.session import materialise

MODEL = "trees"
#: Keys of a model; fold 0 is fitted on all training rows, fold k up to the end of the k-th training fold.
KEYS = ["product_key", "feature_set", "fold"]


def feature_array(names: list[str], features=None) -> Column:
    """Features of a row on the grid, in the order of `names`."""
    return F.array(*[on_grid(features[c] if features is not None else F.col(c)) for c in names])


def all_known(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull())


def by_set(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and (feature_set, x) for each feature set, of rows whose features are all known."""
    sets = F.array(*[F.struct(F.lit(s).alias("feature_set"), feature_array(c).alias("x")) for s, c in FEATURES_BY_SET.items()])
    return rows.select(*keep, F.inline(sets)).where(all_known(F.col("x")))


def training_rows(train: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of every model: all of `train` for fold 0, and those up to each fold's training end."""
    folds = bounds.select("product_key", F.col("fold").cast("int").alias("fold"), "train_end")
    rows = by_set(train, ["product_key", "fecha", on_grid(F.col(TARGET)).alias("y")]).where("y is not null")
    inside = rows.join(folds, "product_key").where("fecha <= train_end").drop("train_end")
    return rows.withColumn("fold", F.lit(0)).unionByName(inside).select(*KEYS, "x", "y")


@dataclass
class ForestEvaluation:
    """Trees next to the baselines of `base`: every table comes from one stored node table."""

    base: Evaluation
    params: TreeParams = TreeParams()

    @cached_property
    def nodes(self) -> DataFrame:
        return forest.fit_forests(training_rows(self.base.train, self.base.bounds), KEYS, self.params)

    @cached_property
    def models(self) -> DataFrame:
        return materialise(forest.packed(self.nodes, KEYS), "forests")

    def metadata(self) -> DataFrame:
        """A row per model, to be stored beside the node table: parameters, features, target and sizes."""
        facts = self.nodes.groupBy(*KEYS).agg(
            F.max("tree").alias("trees"), F.count_if(F.col("feature").isNotNull()).alias("splits"),
            F.max(F.when(F.col("tree") == 0, F.col("rows"))).alias("training_rows"),
            F.max(F.when(F.col("tree") == 0, F.col("value"))).alias("start_value"),
        )
        names = F.create_map(*[x for s, c in FEATURES_BY_SET.items() for x in (F.lit(s), F.array(*map(F.lit, c)))])
        return facts.withColumns({
            "model_name": F.lit(MODEL), "target": F.lit(TARGET), "features": names[F.col("feature_set")],
            "params": F.lit(json.dumps(asdict(self.params), sort_keys=True)),
        })

    def applied(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Rows (`keep`, with fold) scored by the models of their fold, per feature set."""
        scored = by_set(rows, [*keep, "fold"]).join(self.models, KEYS)
        value = forest_prediction(F.col("forest"), F.col("x"), self.params.depth)
        return scored.select(*keep, "fold", "feature_set", value.alias("y_pred"), F.lit(MODEL).alias("model_name"))

    def _labelled(self, rows: DataFrame) -> DataFrame:
        named = rows.withColumn("y_true", F.col(TARGET))
        made = self.applied(named, ["product_key", "producto", "provincia", "fecha", "y_true"])
        return made.withColumnRenamed("product_key", "product_id")

    @cached_property
    def predictions(self) -> DataFrame:
        test = self.base.split.where("split = 'test'").withColumn("fold", F.lit(0))
        return self._labelled(test).drop("fold")

    @cached_property
    def oof(self) -> DataFrame:
        inside = assign_folds(self.base.train, self.base.bounds).withColumn("fold", F.col("fold").cast("int"))
        return self._labelled(inside)

    def grid(self, prefixes: list[int], weights: list[float] = BLEND_WEIGHTS) -> DataFrame:
        """Validation error of the first n trees, blended with the last value: one pass for all candidates.

        A prefix of a boosted forest is the forest with fewer rounds, so nothing is fitted again.
        """
        inside = assign_folds(self.base.train, self.base.bounds).withColumn("fold", F.col("fold").cast("int"))
        rows = by_set(inside, ["product_key", "fold", F.col(TARGET).alias("y"), F.col("target_lag_1").alias("last")])
        rows = rows.join(self.models, KEYS)
        values = forest.tree_values(F.col("forest"), F.col("x"), self.params.depth)
        rows = rows.select(*KEYS, "y", "last", values.alias("values"), F.explode(F.array(*map(F.lit, prefixes))).alias("trees"))
        total = F.aggregate(F.slice("values", F.lit(1), F.col("trees") + 1), F.lit(0).cast("long"), lambda a, v: a + v)
        rows = rows.withColumn("raw", forest.off_grid(total)).withColumn("blend_weight", F.explode(F.array(*map(F.lit, weights))))
        error = F.col("y") - blend(F.col("raw"), F.col("last"), F.col("blend_weight"))
        by = ["product_key", "feature_set", "trees", "blend_weight"]
        per_fold = rows.groupBy(*by, "fold").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))
        mae = per_fold.groupBy(*by).agg(F.avg("mae").alias("validation_mae_mean"))
        return candidate_score(per_fold, by).join(mae, by)

    def importances(self) -> DataFrame:
        """Gain shares of every product and feature set, of the models on all training rows."""
        names = F.create_map(*[x for s, c in FEATURES_BY_SET.items() for x in (F.lit(s), F.array(*map(F.lit, c)))])
        final = self.nodes.where("fold = 0").drop("fold")
        return forest.gain_shares(final, ["product_key", "feature_set"], names[F.col("feature_set")])

    def predictors(self) -> dict[str, Predictor]:
        """One-step predictors over the columns that `with_models` adds."""
        def predictor(name: str) -> Predictor:
            return lambda features: once(
                feature_array(FEATURES_BY_SET[name], features),
                lambda x: F.when(all_known(x), forest_prediction(F.col(f"forest_{name}"), x, self.params.depth)),
            )

        return {f"{MODEL}/{s}": predictor(s) for s in FEATURES_BY_SET}

    def with_models(self, state: DataFrame, fold: Column) -> DataFrame:
        """`state` with the packed forests of its product, those of `fold`."""
        wide = self.models.groupBy("product_key", "fold").agg(
            *[F.first(F.when(F.col("feature_set") == s, F.col("forest")), ignorenulls=True).alias(f"forest_{s}") for s in FEATURES_BY_SET]
        )
        return state.withColumn("fold", fold).join(wide, ["product_key", "fold"])

    @cached_property
    def horizons(self) -> DataFrame:
        """Recursive forecasts from every test date: predictions become the history of the next step."""
        made = rolling_origin_forecasts(
            self.base.split, self.predictors(), ["product_key", "provincia_key", "provincia"],
            prepare=lambda state: self.with_models(state, F.lit(0)),
        )
        return split_label(made).withColumnRenamed("product_key", "product_id")

    @cached_property
    def operational(self) -> DataFrame:
        """Forecasts from the end of the last training fold, by the models of that fold."""
        last = self.base.bounds.where("fold = windows").select(F.col("product_key").alias("of"), F.col("fold").cast("int").alias("last_fold"))

        def prepare(state: DataFrame) -> DataFrame:
            return self.with_models(state.join(last, F.col("product_key") == F.col("of")).drop("of"), F.col("last_fold"))

        made = operational_forecasts(self.base.train, self.base.bounds, self.predictors(), prepare=prepare)
        return split_label(made).withColumnRenamed("product_key", "product_id")

    @cached_property
    def metrics(self) -> DataFrame:
        """Metrics of the trees and the baselines together."""
        tables = ("predictions", "oof", "operational")
        return joined_metrics(*[getattr(self.base, t).unionByName(getattr(self, t), allowMissingColumns=True) for t in tables])

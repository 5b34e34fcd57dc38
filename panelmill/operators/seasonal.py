"""Seasonal autoregressions of every entity at once, from sums of products.

Each candidate regresses the target on one or two of its lags and inputs. All of them, for all entities and
folds, come from one grouped aggregation of cross products; sums are exact decimals, so coefficients do not
depend on the partitioning. A fitted model is a row of coefficients, and forecasts are column expressions.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.constants import MIN_ENTITY_ROWS, TARGET
from panelmill.functions.numbers import stable_forecast
from panelmill.operators.forest import on_grid
from panelmill.operators.horizons import Predictor, latest_state, recursive_forecast
from panelmill.operators.metrics import candidate_score
from panelmill.operators.windows import ENTITY
from panelmill.session import materialise

PRODUCER = "precio_productor_usdkg_filled"
INPUTS = {"c_lag_1": "target_lag_1", "c_lag_12": "target_lag_12", "c_producer": PRODUCER}
#: Inputs of each candidate; the first repeats the last value and is what remains when no other is usable.
CANDIDATES = {
    "base": [(), ("c_lag_1",), ("c_lag_12",), ("c_lag_1", "c_lag_12")],
    "full": [(), ("c_lag_1",), ("c_lag_12",), ("c_lag_1", "c_lag_12"), ("c_lag_1", "c_producer"), ("c_lag_12", "c_producer")],
}
COEFFICIENTS = ["c_0", *INPUTS]
#: Months over which a candidate's forecast from the end of its training rows has to stay stable.
STABLE_STEPS = 6


def _term(coefficient: Column, value: Column) -> Column:
    """A product in which a zero coefficient needs no value."""
    return F.when(coefficient == 0, F.lit(0.0)).otherwise(coefficient * value)


def one_step(coefficients: dict[str, Column], values) -> Column:
    """Prediction of the next value from coefficients and feature columns."""
    total = coefficients["c_0"]
    for name, feature in INPUTS.items():
        total = total + _term(coefficients[name], values[feature])
    return total


def _fitted(names: tuple[str, ...], rows: int) -> Column:
    """Coefficients of a candidate from the sums `n`, `s_<i>` and `s_<i>_<j>` (y is variable `y`); null where
    its inputs do not vary on their own or the entity has fewer than `rows` rows."""
    n = F.col("n").cast("decimal(10,0)")

    def centred(i: str, j: str) -> Column:
        i, j = sorted((i, j))
        return (n * F.col(f"s_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}")).cast("double")

    slopes = {}
    if not names:
        slopes, known = {"c_lag_1": F.lit(1.0)}, F.lit(True)
    elif len(names) == 1:
        x = names[0]
        known = centred(x, x) > 0
        slopes[x] = centred(x, "y") / centred(x, x)
    else:
        a, b = names
        det = centred(a, a) * centred(b, b) - centred(a, b) * centred(a, b)
        known = det > 1e-9 * centred(a, a) * centred(b, b)
        slopes[a] = (centred(a, "y") * centred(b, b) - centred(b, "y") * centred(a, b)) / det
        slopes[b] = (centred(b, "y") * centred(a, a) - centred(a, "y") * centred(a, b)) / det
    mean = F.lit(0.0)
    if names:
        known = known & (F.col("n") >= rows)
        mean = F.col("s_y").cast("double")
        for x, slope in slopes.items():
            mean = mean - slope * F.col(f"s_{x}").cast("double")
        mean = mean / F.col("n") / on_grid_unit()
    return F.when(known, F.struct(mean.alias("c_0"), *[slopes.get(c, F.lit(0.0)).alias(c) for c in INPUTS]))


def on_grid_unit() -> Column:
    from panelmill.operators.forest import GRID

    return F.lit(float(GRID))


def fit_candidates(train: DataFrame, bounds: DataFrame, rows: int = MIN_ENTITY_ROWS) -> DataFrame:
    """(entity, fold, feature_set, candidate, COEFFICIENTS): fold 0 has all training rows, fold k those up to
    the end of the k-th. Candidates that cannot be fitted are left out."""
    folds = bounds.select("product_key", F.col("fold").cast("int").alias("fold"), "train_end")
    values = {"y": TARGET, **INPUTS}
    whole = train.select(*ENTITY, "fecha", *[on_grid(F.col(c)).cast("decimal(19,0)").alias(v) for v, c in values.items()])
    inside = whole.join(folds, "product_key").where("fecha <= train_end").drop("train_end")
    every = whole.withColumn("fold", F.lit(0)).unionByName(inside)
    pairs = [tuple(sorted(p)) for p in combinations_with_replacement(values, 2)]
    sums = every.groupBy(*ENTITY, "fold").agg(
        F.count("*").alias("n"), *[F.sum(v).alias(f"s_{v}") for v in values],
        *[F.sum((F.col(a) * F.col(b)).cast("decimal(38,0)")).alias(f"s_{a}_{b}") for a, b in pairs],
    )
    made = [
        F.struct(F.lit(s).alias("feature_set"), F.lit(i).alias("candidate"), _fitted(names, rows).alias("c"))
        for s, all_of in CANDIDATES.items() for i, names in enumerate(all_of)
    ]
    fitted = sums.select(*ENTITY, "fold", F.explode(F.array(*made)).alias("m")).where("m.c is not null")
    return fitted.select(*ENTITY, "fold", "m.feature_set", "m.candidate", "m.c.*")


def coefficient_columns() -> dict[str, Column]:
    return {c: F.col(c) for c in COEFFICIENTS}


def predictor() -> Predictor:
    """One-step predictor over coefficient columns of the state."""
    return lambda features: one_step(coefficient_columns(), features)


def predicted(rows: DataFrame, models: DataFrame, on: list[str]) -> DataFrame:
    """`rows` with the one-step prediction `y_pred` of each of their `models`."""
    values = {f: F.col(f) for f in INPUTS.values()}
    return rows.join(models, on).withColumn("y_pred", one_step(coefficient_columns(), values)).drop(*COEFFICIENTS)


def forecasts(state: DataFrame, steps: int) -> DataFrame:
    """Recursive forecasts of states that carry coefficient columns."""
    return recursive_forecast(state, {"seasonal": predictor()}, steps)


def chosen_models(train: DataFrame, folded: DataFrame, candidates: DataFrame) -> DataFrame:
    """(entity, feature_set, candidate, COEFFICIENTS, validation_rmse_mean, order_fallback_used): per entity
    and feature set the candidate of least validation error whose forecast stays stable.

    `folded` has the validation rows of each fold. A candidate that misses a fold has no error. Where the
    best one is unstable the next is taken, and the last value where none is left.
    """
    keys = [*ENTITY, "feature_set", "candidate"]
    errors = predicted(folded, candidates, [*ENTITY, "fold"])
    per_fold = errors.groupBy(*keys, "fold").agg(F.sqrt(F.avg((F.col(TARGET) - F.col("y_pred")) ** 2)).alias("rmse"))
    scores = candidate_score(per_fold, keys).drop("n_windows")
    final = candidates.where("fold = 0").drop("fold")
    ahead = forecasts(latest_state(train).join(final, ENTITY), STABLE_STEPS)
    stable = stable_forecast(F.transform("forecasts", lambda f: f["y_pred"]), F.col("history"))
    ranked = ahead.select(*keys, *COEFFICIENTS, stable.alias("stable")).join(scores, keys, "left")
    order = F.struct(
        (F.col("candidate") > 0) & ~(F.col("stable") & F.col("validation_rmse_mean").isNotNull()), F.col("validation_rmse_mean").isNull(),
        "validation_rmse_mean", "candidate",
    )
    by_error = F.struct(F.col("validation_rmse_mean").isNull(), "validation_rmse_mean", "candidate")
    group = Window.partitionBy(*ENTITY, "feature_set")
    picked = ranked.withColumns({"place": F.row_number().over(group.orderBy(order)), "first": F.min(by_error).over(group)["candidate"]})
    return picked.where("place = 1").select(*keys, *COEFFICIENTS, "validation_rmse_mean", (F.col("first") != F.col("candidate")).alias("order_fallback_used"))


def fit_entities(train: DataFrame, folded: DataFrame, bounds: DataFrame) -> DataFrame:
    """The chosen model of every entity and feature set, as a stored table of coefficients."""
    candidates = materialise(fit_candidates(train, bounds), "candidates")
    return materialise(chosen_models(train, folded, candidates), "seasonal-models")

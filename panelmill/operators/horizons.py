"""Recursive multi-step forecasts for all entities and origins at once.

The state of a forecast is one row: the last twelve target values as an array and the last known
exogenous values. Steps are unrolled column expressions, so there is no loop over rows, and the
frames are bounded (twelve rows back, a few rows ahead).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.constants import (
    CALENDAR_FEATURES, ENTITY_EXOGENOUS, EXOGENOUS_FEATURES, EXOGENOUS_LAGS, HORIZONS,
    MARKET_CONTEXT_FEATURES, ROLLING_SIZES, TARGET, TARGET_LAGS,
)
from panelmill.functions.dates import calendar_columns
from panelmill.operators.windows import ENTITY, entity_window
from panelmill.session import spread

HISTORY = max(TARGET_LAGS.values())
CARRIED = [*MARKET_CONTEXT_FEATURES, *EXOGENOUS_FEATURES, "provincia_id"]
# A one-step predictor turns the feature columns of one future row into a prediction.
Predictor = Callable[[Mapping[str, Column]], Column]


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _deviation(values: Column) -> Column:
    """Sample deviation of a short array; a single value gives 0."""
    mean = _mean(values)
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1))).otherwise(F.lit(0.0))


class FeatureRow(Mapping):
    """Feature columns by name, built only when a predictor asks for them."""

    def __init__(self, makers: dict[str, Callable[[], Column]]):
        self._makers = makers

    def __getitem__(self, name: str) -> Column:
        return self._makers[name]()

    def __iter__(self):
        return iter(self._makers)

    def __len__(self):
        return len(self._makers)


def history_features(history: Column) -> FeatureRow:
    """Lags, rolling statistics and momentum of the next step, from past values.

    Unlike the training features, rolling statistics use what is there when history is short.
    """
    def lag(back: int) -> Column:
        return F.try_element_at(history, F.lit(-back))

    def rolled(stat: Callable[[Column], Column], size: int) -> Column:
        start = F.greatest(F.size(history) - size + 1, F.lit(1))
        return F.when(F.size(history) > 0, stat(F.slice(history, start, F.lit(size))))

    makers = {name: partial(lag, back) for name, back in TARGET_LAGS.items()}
    for size in ROLLING_SIZES:
        makers[f"target_rolling_mean_{size}"] = partial(rolled, _mean, size)
        makers[f"target_rolling_std_{size}"] = partial(rolled, _deviation, size)
    for back in (3, 6):
        makers[f"target_momentum_1_{back}"] = partial(lambda k: lag(1) - lag(k), back)
    return FeatureRow(makers)


def future_features(last_known: str, known: list[str], history: Column, date: Column) -> FeatureRow:
    """Full feature row of a future month: exact calendar, carried exogenous values, own history.

    A lagged exogenous column takes the last value of the column it lags.
    """
    makers = {c: partial(lambda n: calendar_columns(date)[n], c) for c in CALENDAR_FEATURES}
    makers |= {c: partial(F.col, f"{last_known}.{c}") for c in known}
    makers |= {
        lag: partial(F.col, f"{last_known}.{base}") for lag, (base, _) in EXOGENOUS_LAGS.items() if base in known
    }
    past = history_features(history)
    return FeatureRow(makers | {name: partial(past.__getitem__, name) for name in past})


def future_exogenous(df: DataFrame, steps: int, keys: list[str] | None = None) -> DataFrame:
    """Exogenous rows for the next `steps` months after each entity's last row."""
    from panelmill.operators.windows import last_row

    keys = ENTITY if keys is None else keys
    columns = [c for c in ENTITY_EXOGENOUS if c in df.columns and c not in CALENDAR_FEATURES]
    latest = last_row(df.select(*keys, "fecha", *columns), keys)
    ahead = latest.withColumn("paso", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn(
        "fecha", F.add_months("fecha", F.col("paso"))
    )
    calendar = {c: v for c, v in calendar_columns(F.col("fecha")).items() if c in CALENDAR_FEATURES}
    return ahead.withColumns(calendar)


def origin_state(df: DataFrame, keys: list[str] | None = None, target: str = TARGET, ahead: int = max(HORIZONS)) -> DataFrame:
    """Per row: what was known strictly before it, and the true values that may follow.

    The months a forecast can reach hold at most `ahead` rows from the origin on, so actual
    values come from the same window instead of a join.
    """
    keys = ENTITY if keys is None else keys
    spec = entity_window(keys)
    known = [c for c in CARRIED if c in df.columns]
    past = spec.rowsBetween(-HISTORY, -1)
    previous = spec.rowsBetween(-1, -1)
    coming = spec.rowsBetween(0, ahead - 1)
    return spread(df, keys).withColumns(
        {
            "history": F.collect_list(F.col(target)).over(past),
            "history_date": F.last("fecha").over(previous),
            "last_known": F.last(F.struct(*[F.col(c) for c in known]) if known else F.struct(F.lit(1).alias("none__"))).over(previous),
            "coming": F.collect_list(F.struct(F.col("fecha").alias("f"), F.col(target).alias("y"))).over(coming),
        }
    )


def latest_state(df: DataFrame, keys: list[str] | None = None, target: str = TARGET) -> DataFrame:
    """Per entity: what is known after its last row, from which months beyond the data are forecast."""
    keys = ENTITY if keys is None else keys
    spec = entity_window(keys)
    known = [c for c in CARRIED if c in df.columns]
    state = df.select(
        *keys, F.col("fecha").alias("history_date"), F.lead("fecha").over(spec).alias("next__"),
        F.collect_list(F.col(target)).over(spec.rowsBetween(-HISTORY + 1, 0)).alias("history"),
        F.struct(*[F.col(c) for c in known]).alias("last_known"),
    )
    return state.where("next__ is null").drop("next__")


def recursive_forecast(
    state: DataFrame, predictors: dict[str, Predictor], steps: int = max(HORIZONS), keep: list[str] | None = None
) -> DataFrame:
    """Adds `forecasts`: a (model, horizonte, fecha_objetivo, y_pred) entry per predictor and step.

    Each step's prediction is appended to the history the next step sees. With `keep`, entries also
    hold these columns of the future row that the predictor saw.
    """
    known = [f.name for f in state.schema["last_known"].dataType.fields if f.name != "none__"]
    current, entries, temporary = state, [], []
    for step in range(1, steps + 1):
        date = F.add_months("history_date", step)
        made = {}
        for i, (name, predictor) in enumerate(predictors.items()):
            earlier = [F.col(f"p__{i}_{s}") for s in range(1, step)]
            history = F.concat("history", F.array(*earlier)) if earlier else F.col("history")
            features = future_features("last_known", known, history, date)
            made[f"p__{i}_{step}"] = predictor(features)
            entries.append(
                F.struct(
                    F.lit(name).alias("model"),
                    F.lit(step).alias("horizonte"),
                    date.alias("fecha_objetivo"),
                    F.col(f"p__{i}_{step}").alias("y_pred"),
                    *[features[c].alias(c) for c in keep or ()],
                )
            )
        current = current.withColumns(made)  # one projection per step for all predictors
        temporary += made
    return current.withColumn("forecasts", F.array(*entries)).drop(*temporary)


def explode_forecasts(forecasts: DataFrame, keep: list[str]) -> DataFrame:
    """One row per step that has an actual value among the `coming` rows.

    The array is never empty. From a generator that is not outer, the optimiser would infer a test of its
    size, and push it with all that the entries are made of below every step.
    """
    rows = forecasts.select(*keep, "coming", F.inline_outer("forecasts"))
    match = F.filter("coming", lambda c: c["f"] == F.col("fecha_objetivo"))
    return (
        rows.withColumn("actual", F.try_element_at(match, F.lit(1)))
        .where("actual is not null")
        .select(*keep, "model", "horizonte", "fecha_objetivo", F.col("actual.y").alias("y_true"), "y_pred")
    )


def rolling_origin_forecasts(
    split: DataFrame, predictors: dict[str, Predictor], keys: list[str] | None = None, steps: int = max(HORIZONS),
    prepare: Callable[[DataFrame], DataFrame] = lambda state: state,
) -> DataFrame:
    """Forecasts from every test date, using only rows before it.

    `prepare` may add what predictors need to the states, such as their fitted models.
    """
    keys = ENTITY if keys is None else keys
    origins = prepare(origin_state(split, keys, ahead=steps).where("split = 'test' and history_date is not null"))
    made = recursive_forecast(origins.withColumnRenamed("fecha", "fecha_origen"), predictors, steps)
    return explode_forecasts(made, [*keys, "fecha_origen"])


def operational_forecasts(
    train: DataFrame, bounds: DataFrame, predictors: dict[str, Predictor], keys: list[str] | None = None,
    group: list[str] | None = None, steps: int = max(HORIZONS), prepare: Callable[[DataFrame], DataFrame] = lambda state: state,
) -> DataFrame:
    """Forecasts of each entity from the end of its product's last training fold."""
    keys = ENTITY if keys is None else keys
    group = ["product_key"] if group is None else group
    last = bounds.where("fold = windows").select(*group, "train_end", "val_start", "val_end")
    inside = train.join(last, group).where("fecha <= val_end")
    spec = entity_window(keys)
    state = origin_state(inside, keys, ahead=steps)
    state = state.withColumn("before__", F.lag("fecha").over(spec))
    first_after = (F.col("fecha") > F.col("train_end")) & (F.col("before__") <= F.col("train_end"))
    made = recursive_forecast(prepare(state.where(first_after)), predictors, steps)
    return explode_forecasts(made, [*keys])

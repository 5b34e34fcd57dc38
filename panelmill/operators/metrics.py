"""Regression-quality aggregates, groupable by any key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.constants import EXPLORATORY_BELOW

SERIES = ["product_id", "model_name", "feature_set"]


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mape(y: Column, p: Column) -> Column:
    """Mean absolute percentage error over rows with a non-zero truth, null when none is left."""
    return F.avg(F.when(y != 0, F.abs((y - p) / y))) * 100


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; null below two rows; a constant truth scores 1 when exact and 0 otherwise."""
    n = F.count(F.lit(1))
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * n
    constant = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(n < 2, F.lit(None).cast("double")).when(sst == 0, constant).otherwise(1 - sse / sst)


def same_direction(y: Column, p: Column, y_before: Column, p_before: Column) -> Column:
    """1 or 0 for agreement of the two differences, null where there is no previous row."""
    agree = F.signum(y - y_before) == F.signum(p - p_before)
    return F.when(y_before.isNotNull() & p_before.isNotNull(), agree.cast("double"))


def with_direction(df: DataFrame, by: list[str], entity: list[str]) -> DataFrame:
    """Adds `direction__` from consecutive rows of one entity."""
    spec = Window.partitionBy(*by, *[e for e in entity if e not in by]).orderBy("fecha")
    return df.withColumn(
        "direction__",
        same_direction(
            F.col("y_true"), F.col("y_pred"), F.lag("y_true").over(spec), F.lag("y_pred").over(spec)
        ),
    )


def with_row_order_direction(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds `direction__` from consecutive rows of the whole group in the given order.

    Differences cross from one entity to the next. Rows are linked inside each value of the
    first order column, and its first row to the last row of the value before, so no task
    sorts a whole group.
    """
    outer, inner = order[0], order[1:]
    pair = F.struct(F.col("y_true").alias("y"), F.col("y_pred").alias("p"))
    ends = df.groupBy(*by, outer).agg(F.max_by(pair, F.struct(*inner)).alias("end__"))
    before = ends.select(
        *by, outer, F.lag("end__").over(Window.partitionBy(*by).orderBy(outer)).alias("before__")
    )
    inside = F.lag(pair).over(Window.partitionBy(*by, outer).orderBy(*inner))
    linked = df.join(before, [*by, outer]).withColumn("from__", F.coalesce(inside, F.col("before__")))
    return linked.withColumn(
        "direction__",
        same_direction(F.col("y_true"), F.col("y_pred"), F.col("from__.y"), F.col("from__.p")),
    ).drop("before__", "from__")


def metric_columns(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    a, b = F.col(y), F.col(p)
    return [
        mae(a, b).alias("mae"),
        rmse(a, b).alias("rmse"),
        mape(a, b).alias("mape"),
        r2(a, b).alias("r2"),
        F.avg("direction__").alias("directional_accuracy"),
        F.count(F.lit(1)).alias("n_test"),
    ]


def regression_metrics(
    predictions: DataFrame,
    by: list[str],
    entity: list[str] | None = None,
    row_order: list[str] | None = None,
) -> DataFrame:
    """All metrics per group. Direction is followed per entity, or over `row_order` when given."""
    if row_order:
        directed = with_row_order_direction(predictions, by, row_order)
    else:
        directed = with_direction(predictions, by, entity or ["product_id", "provincia"])
    return directed.groupBy(*by).agg(*metric_columns())


def entity_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Metrics per province, flagged as exploratory when the test part is small."""
    keys = [*(SERIES if by is None else by), "provincia"]
    scored = regression_metrics(predictions, keys, ["provincia"])
    return scored.withColumn("exploratorio", F.col("n_test") < EXPLORATORY_BELOW)


def pooled_rmse(errors: DataFrame, by: list[str], alias: str) -> DataFrame:
    """RMSE over all rows of a group, whatever entity or step they come from."""
    return errors.groupBy(*by).agg(rmse(F.col("y_true"), F.col("y_pred")).alias(alias))


def mean_of_window_rmse(oof: DataFrame, by: list[str], windows: list[str], alias: str) -> DataFrame:
    """Unweighted mean of the RMSE of each validation window."""
    each = oof.groupBy(*by, *windows).agg(rmse(F.col("y_true"), F.col("y_pred")).alias("window_rmse"))
    for level in reversed(windows[1:]):
        outer = [*by, *windows[: windows.index(level)]]
        each = each.groupBy(*outer).agg(F.avg("window_rmse").alias("window_rmse"))
    return each.groupBy(*by).agg(F.avg("window_rmse").alias(alias))


def candidate_score(scores: DataFrame, by: list[str], value: str = "rmse") -> DataFrame:
    """Mean over windows; one failed window (null or not finite) rejects the candidate."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    return scores.groupBy(*by).agg(
        F.when(~F.bool_or(bad), F.avg(value)).alias("validation_rmse_mean"),
        F.count(F.lit(1)).alias("n_windows"),
    )

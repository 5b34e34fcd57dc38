"""Row-based window features over one entity's monthly rows.

A partition is one product and province, so it never holds more rows than there are months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelmill.constants import EXOGENOUS_LAGS, ROLLING_SIZES, TARGET, TARGET_LAGS

ENTITY = ["product_key", "provincia_key"]


def entity_window(keys: list[str] | None = None, date: str = "fecha") -> WindowSpec:
    return Window.partitionBy(*(ENTITY if keys is None else keys)).orderBy(date)


def full_window(value: Column, stat, size: int, spec: WindowSpec, start: int, end: int) -> Column:
    """Rolling statistic that is null unless all `size` rows of the frame have a value."""
    frame = spec.rowsBetween(start, end)
    return F.when(F.count(value).over(frame) == size, stat(value).over(frame))


def previous_rows_stat(value: Column, stat, size: int, spec: WindowSpec) -> Column:
    return full_window(value, stat, size, spec, -size, -1)


def current_rows_stat(value: Column, stat, size: int, spec: WindowSpec) -> Column:
    return full_window(value, stat, size, spec, -(size - 1), 0)


def forward_fill(value: Column, spec: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0))


def fill_both_ways(value: Column, spec: WindowSpec) -> Column:
    """Forward fill, then backward fill for the head (it reads later rows; legacy series only)."""
    later = F.first(value, ignorenulls=True).over(spec.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(forward_fill(value, spec), later)


def target_lag_columns(spec: WindowSpec, target: str = TARGET) -> dict[str, Column]:
    y = F.col(target)
    columns = {name: F.lag(y, rows).over(spec) for name, rows in TARGET_LAGS.items()}
    for size in ROLLING_SIZES:
        columns[f"target_rolling_mean_{size}"] = previous_rows_stat(y, F.avg, size, spec)
        columns[f"target_rolling_std_{size}"] = previous_rows_stat(y, F.stddev_samp, size, spec)
    for back in (3, 6):
        columns[f"target_momentum_1_{back}"] = F.lag(y, 1).over(spec) - F.lag(y, back).over(spec)
    return columns


def exogenous_lag_columns(spec: WindowSpec) -> dict[str, Column]:
    return {name: F.lag(base, rows).over(spec) for name, (base, rows) in EXOGENOUS_LAGS.items()}


def add_lag_features(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    spec = entity_window(keys)
    return df.withColumns({**target_lag_columns(spec), **exogenous_lag_columns(spec)})


def dense_ids(df: DataFrame, group: list[str], name: str, alias: str) -> DataFrame:
    """0-based position of each distinct name within its group, in name order."""
    order = Window.partitionBy(*group).orderBy(name)
    return df.select(*group, name).distinct().withColumn(alias, F.row_number().over(order) - 1)


def first_occurrence_rank(group: list[str], score: str, position: str) -> Column:
    """Descending rank; equal scores keep their order of appearance."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), F.asc(position)))


def best_row(df: DataFrame, group: list[str], criteria: list[str]) -> DataFrame:
    """First row per group by ascending criteria, nulls last, kept by a mergeable minimum."""
    order = [
        part
        for c in criteria
        for part in (F.col(c).isNull().alias(f"{c}__missing"), F.col(c).alias(f"{c}__value"))
    ]
    rest = [c for c in df.columns if c not in group]
    chosen = df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return chosen.select(*group, "best.*").select(*df.columns)


def last_row(df: DataFrame, group: list[str], date: str = "fecha") -> DataFrame:
    """Latest row of each group."""
    rest = [c for c in df.columns if c not in group]
    return (
        df.groupBy(*group)
        .agg(F.max_by(F.struct(*rest), F.col(date)).alias("last"))
        .select(*group, "last.*")
        .select(*df.columns)
    )


def leading_values(df: DataFrame, group: list[str], value: str, order: list[Column], k: int, alias: str) -> DataFrame:
    """First `k` values per group joined with ` | `."""
    placed = df.withColumn("place__", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    listed = F.array_sort(F.collect_list(F.struct("place__", F.col(value).alias("value"))))
    return (
        placed.where(F.col("place__") <= k)
        .groupBy(*group)
        .agg(F.array_join(F.transform(listed, lambda x: x["value"]), " | ").alias(alias))
    )


def sequence_windows(
    df: DataFrame,
    features: list[str],
    length: int,
    alias: str = "window",
    keys: list[str] | None = None,
    include_current: bool = True,
) -> DataFrame:
    """The last `length` feature rows of each entity as one array; shorter heads are dropped."""
    end = 0 if include_current else -1
    frame = entity_window(keys).rowsBetween(end - length + 1, end)
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(frame)
    return df.withColumn(alias, rows).where(F.size(alias) == length)

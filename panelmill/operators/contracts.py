"""Checks on a feature dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.constants import REQUIRED_DATASET_COLUMNS, TARGET
from panelmill.functions.headers import non_numeric, require_columns


def dataset_problems(df: DataFrame, features: list[str], target: str = TARGET, date: str = "fecha") -> DataFrame:
    """One row per column with missing values where none are allowed."""
    checked = list(dict.fromkeys([date, *features, target]))
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in checked])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in checked])
    return one.select(F.inline(cells)).where("nulls > 0")


def validate_dataset(df: DataFrame, features: list[str], target: str = TARGET, date: str = "fecha") -> DataFrame:
    """Returns the dataset, or raises for missing columns, wrong types or missing values."""
    require_columns(df, REQUIRED_DATASET_COLUMNS, "dataset")
    require_columns(df, [*features, target, date], "dataset")
    wrong = non_numeric(df, [*features, target])
    if wrong:
        raise ValueError(f"columns are not numeric: {wrong}")
    problems = dataset_problems(df, features, target, date).collect()
    if problems:
        raise ValueError(f"missing values: {({r['column']: r['nulls'] for r in problems})}")
    return df


def enforce(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """`df`, whose plan fails with `message` at the first row that does not meet `condition`."""
    return df.where(F.coalesce(F.assert_true(F.coalesce(condition, F.lit(False)), message).cast("boolean"), F.lit(True)))


def enforce_dataset(df: DataFrame, features: list[str], target: str = TARGET, date: str = "fecha") -> DataFrame:
    """The dataset, checked while it is read: columns and types now, missing values in the pass that uses it."""
    require_columns(df, list(dict.fromkeys([*REQUIRED_DATASET_COLUMNS, *features, target, date])), "dataset")
    wrong = non_numeric(df, [*features, target])
    if wrong:
        raise ValueError(f"columns are not numeric: {wrong}")
    for c in dict.fromkeys([date, *features, target]):
        df = enforce(df, F.col(c).isNotNull(), f"missing values: {c}")
    return df


def select_or_fail(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Rows that meet `condition`; the query fails with `message` if there are none, instead of giving no rows.

    The count that decides is one more aggregate in the same plan; nothing is collected.
    """
    wanted = df.where(condition)
    n = F.col("n__")
    guard = df.agg(F.count_if(condition).alias("n__")).where(F.when(n == 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(False)))
    return wanted.unionByName(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))

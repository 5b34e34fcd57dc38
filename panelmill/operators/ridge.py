"""Linear sequence models for all products at once, fitted from cross-product sums.

Ridge regression only needs X'X and X'y. Both are sums over rows, so partitions add up their
own rows, and the sums of the date chunks give every expanding fold without touching the rows
again. What is shuffled depends on the number of features, not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 16


def _sums_schema(keys: list[T.StructField]) -> T.StructType:
    return T.StructType([*keys, T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])


def cross_sums(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per key: the upper sums of [1, x, y]'[1, x, y] as one flat array, and the row count."""
    fields = [f for f in df.schema.fields if f.name in keys]
    fields.sort(key=lambda f: keys.index(f.name))
    schema = _sums_schema([*fields, T.StructField("salt", T.IntegerType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, list] = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False):
                matrix = np.column_stack([np.ones(len(rows)), np.vstack(rows[x].to_numpy()), rows[y].to_numpy()])
                sums = matrix.T @ matrix
                if key in kept:
                    kept[key][0] += sums
                    kept[key][1] += len(rows)
                else:
                    kept[key] = [sums, len(rows)]
        salt = TaskContext.get().partitionId() % SALTS
        for key, (sums, n) in kept.items():
            yield pd.DataFrame([[*key, salt, sums.ravel(), n]], columns=schema.names)

    salted = df.select(*keys, x, y).mapInPandas(partial, schema)
    half = _add_up(salted, [*keys, "salt"], schema)
    return _add_up(half.drop("salt"), keys, _sums_schema(fields))


def _add_up(sums: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """Adds arrays element by element, holding one array at a time."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, first = None, 0, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                values = np.asarray(row.sums)
                total = values.copy() if total is None else total + values
                n += row.n
                first = row if first is None else first
        yield pd.DataFrame([[*[getattr(first, k) for k in keys], total, n]], columns=schema.names)

    return sums.groupBy(*keys).applyInPandas(add, schema)


def expanding_sums(chunk_sums: DataFrame, keys: list[str], chunk: str = "chunk") -> DataFrame:
    """Sums over all chunks up to each chunk: the training state of the fold that follows.

    A group holds one row per chunk.
    """
    columns = [*keys, chunk, "sums", "n"]

    def accumulated(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(chunk)
        upto = np.cumsum(np.vstack(ordered["sums"].to_numpy()), axis=0)
        return ordered.assign(sums=list(upto), n=ordered["n"].cumsum())[columns]

    ordered = chunk_sums.select(*columns)
    return ordered.groupBy(*keys).applyInPandas(accumulated, ordered.schema)


def solve(sums: DataFrame, keys: list[str], penalties: list[float]) -> DataFrame:
    """Coefficients (intercept first) per key and penalty, one small solve each.

    `low` and `spread` give the fitted minimum and range of every input. The penalty applies to
    inputs scaled to 0-1; the scaling is done on the sums, and the coefficients returned apply to
    unscaled inputs.
    """
    fields = sorted((f for f in sums.schema.fields if f.name in keys), key=lambda f: keys.index(f.name))
    schema = T.StructType([*fields, T.StructField("penalty", T.DoubleType()), T.StructField("beta", T.ArrayType(T.DoubleType()))])

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                size = int(round(len(row.sums) ** 0.5))
                moments = np.asarray(row.sums).reshape(size, size)
                spread = np.where(np.asarray(row.spread) == 0, 1.0, row.spread)
                to_scaled = np.diag(np.concatenate([[1.0], 1.0 / spread]))
                to_scaled[0, 1:] = -np.asarray(row.low) / spread
                gram = to_scaled.T @ moments[:-1, :-1] @ to_scaled
                target = to_scaled.T @ moments[:-1, -1]
                for penalty in penalties:
                    ridge = np.eye(size - 1) * penalty
                    ridge[0, 0] = 0.0
                    beta = to_scaled @ np.linalg.lstsq(gram + ridge, target, rcond=None)[0]
                    yield pd.DataFrame([[*[getattr(row, k) for k in keys], penalty, beta]], columns=schema.names)

    return sums.select(*keys, "sums", "low", "spread").mapInPandas(solved, schema)


def linear_prediction(x: Column, beta: Column) -> Column:
    products = F.zip_with(x, F.slice(beta, 2, F.size(x)), lambda a, b: a * b)
    return F.element_at(beta, 1) + F.aggregate(products, F.lit(0.0), lambda a, b: a + b)

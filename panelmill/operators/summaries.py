"""Coverage summaries, frame profiles, correlations and scaled series."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions.numbers import scale
from panelmill.operators.grouping import exact_quantiles


def coverage_counts(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Rows per product and province: the reduced input all coverage summaries share."""
    return df.groupBy(*(extra or []), "producto", "provincia").agg(F.count(F.lit(1)).alias("registros"))


def product_summary(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, number of provinces and their sorted list per product."""
    return counts.groupBy(*(by or []), "producto").agg(
        F.sum("registros").alias("registros"),
        F.count_distinct("provincia").alias("provincias_distintas"),
        F.array_join(F.array_sort(F.collect_set("provincia")), " | ").alias("provincias"),
    )


def province_summary(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return counts.groupBy(*(by or []), "provincia").agg(
        F.sum("registros").alias("registros"), F.count_distinct("producto").alias("productos_distintos")
    )


def coverage_totals(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Valid rows, products and provinces per source."""
    return counts.groupBy(*(by or [])).agg(
        F.sum("registros").alias("registros"),
        F.count_distinct("producto").alias("productos_distintos"),
        F.count_distinct("provincia").alias("provincias_distintas"),
    )


def per_source_and_total(summarise, counts: DataFrame, total_label: str = "consolidado") -> DataFrame:
    """One summary per source and one over all of them, from the same counts."""
    both = F.explode(F.array(F.col("fuente"), F.lit(total_label)))
    return summarise(counts.withColumn("fuente", both).groupBy("fuente", "producto", "provincia").agg(
        F.sum("registros").alias("registros")
    ), ["fuente"])


def top_rows(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, nulls), from a single aggregation."""
    names = columns or df.columns
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in names])))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(F.inline(cells))


def frame_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: type, rows, non-nulls, and either moments and quartiles or, for
    text, distinct values with the most frequent one."""
    names = columns or df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numeric = [c for c in names if c in numeric_columns(df)]
    texts = [c for c in names if types[c] == "string"]
    counts = df.agg(
        F.count(F.lit(1)).alias("rows__"), *[F.count(c).alias(c) for c in names]
    ).select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col("rows__").alias("rows"), F.col(c).alias("count"))
            for c in names
        ]))
    )
    moments = _long(df, numeric, "double").groupBy("column").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ) if numeric else None
    result = counts
    if numeric:
        quartiles = exact_quantiles(_long(df, numeric, "double"), ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
        result = result.join(moments, "column", "left").join(quartiles, "column", "left")
    if texts:
        by_value = _long(df, texts, "string").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("v")))
        described = by_value.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique"), best["v"].alias("top"), (-best["n"]).alias("freq")
        )
        result = result.join(described, "column", "left")
    return result


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlations over pairwise complete rows, in long form, from one aggregation."""
    names = columns or numeric_columns(df)
    pairs = list(combinations_with_replacement(names, 2))
    one = df.agg(*[
        F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    cells = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{i}`").alias("corr"))
        for i, (a, b) in enumerate(pairs)
        for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])
    ]
    return one.select(F.inline(F.array(*cells)))


def fit_ranges(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Minimum and maximum of each column, the state of a min-max scaler."""
    stats = [f(F.col(c)).alias(f"{c}__{n}") for c in columns for f, n in ((F.min, "low"), (F.max, "high"))]
    return df.groupBy(*by).agg(*stats) if by else df.agg(*stats)


def scale_columns(df: DataFrame, ranges: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Columns scaled to the fitted ranges (one row per group, or a single row)."""
    fitted = [f"{c}__{n}" for c in columns for n in ("low", "high")]
    joined = df.join(ranges, by) if by else df.withColumns({n: ranges.select(n).scalar() for n in fitted})
    scaled = {c: scale(F.col(c), F.col(f"{c}__low"), F.col(f"{c}__high")) for c in columns}
    return joined.withColumns(scaled).drop(*fitted)


def monthly_means(df: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(v).alias(out) for out, v in values.items()])


def mean_across_entities(predictions: DataFrame) -> DataFrame:
    """Mean truth and prediction over provinces, per date and model."""
    by = ["product_id", "fecha", "model_name", "feature_set"]
    return monthly_means(predictions, by, {"y_true": "y_true", "y_pred": "y_pred"})


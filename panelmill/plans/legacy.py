"""The earlier single-series plan: one national monthly series with its own lag features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.numbers import box_to_kg
from panelmill.operators.windows import current_rows_stat, fill_both_ways, forward_fill

SERIES = "precio_banano_internacional"
LAGS = range(1, 7)


def monthly_mean(df: DataFrame, value: str, alias: str) -> DataFrame:
    return df.groupBy("fecha").agg(F.avg(value).alias(alias))


def box_price_series(df: DataFrame, price: str) -> DataFrame:
    """Mean price per kilogram from prices per 40-pound box."""
    return monthly_mean(df.select("fecha", box_to_kg(F.col(price)).alias("kg")), "kg", SERIES)


def product_series(df: DataFrame, fragment: str, alias: str = "precio_productor_banano") -> DataFrame:
    """Mean producer price of the products whose name contains `fragment`."""
    return monthly_mean(df.where(F.lower("producto").contains(fragment)), "precio_promedio_usdkg", alias)


def input_series(df: DataFrame, category: str) -> DataFrame:
    return monthly_mean(df.where(F.col("tipo_insumo") == category), "promedio_de_precio", "fertilizantes")


def merge_series(
    prices: DataFrame, ipc: DataFrame, inputs: DataFrame, producer: DataFrame, ipp: DataFrame, start: str
) -> DataFrame:
    """Series joined by month with gaps filled; its windows hold one row per month."""
    merged = prices
    for other in (ipc, inputs, producer, ipp):
        merged = merged.join(other, "fecha", "left")
    spec = Window.partitionBy().orderBy("fecha")
    filled = merged.withColumns(
        {
            "ipc": forward_fill(F.col("ipc"), spec),
            "precio_productor_banano": fill_both_ways(F.col("precio_productor_banano"), spec),
            "ipp": fill_both_ways(F.col("ipp"), spec),
        }
    )
    return filled.where(F.col("fecha") >= F.lit(start).cast("date"))


def add_series_lags(df: DataFrame, value: str = SERIES) -> DataFrame:
    """Lags, differences and rolling statistics that include the current row; complete rows only."""
    spec = Window.partitionBy().orderBy("fecha")
    y = F.col(value)
    columns = {f"lag_{k}": F.lag(y, k).over(spec) for k in LAGS}
    columns |= {f"diff_{k}": y - F.lag(y, k).over(spec) for k in (1, 2)}
    columns["rolling_mean_3"] = current_rows_stat(y, F.avg, 3, spec)
    columns["rolling_std_3"] = current_rows_stat(y, F.stddev_samp, 3, spec)
    return df.withColumns(columns).dropna("any")


def clean_frame(df: DataFrame) -> DataFrame:
    """Header clean-up and removal of duplicate rows."""
    from panelmill.functions.headers import normalise_headers

    return normalise_headers(df, "spaced").dropDuplicates()

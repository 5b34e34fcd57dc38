"""Rankings of products present in both sources, and of the provinces behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.constants import RANKING_RENAMES
from panelmill.functions.headers import drop_unnamed, normalise_headers, rename_headers, require_columns
from panelmill.functions.numbers import weighted_score
from panelmill.functions.text import clean_text, match_key, pick_non_blank
from panelmill.operators.grouping import profile_cells
from panelmill.operators.windows import leading_values

KEYS = ["producto_key", "provincia_key"]


def prepare_source(df: DataFrame, label: str, renames: dict[str, str] | None = None) -> DataFrame:
    """Cleaned product and province names with the source label; blank names are dropped."""
    named = rename_headers(normalise_headers(df, "strip"), RANKING_RENAMES if renames is None else renames)
    usable = require_columns(drop_unnamed(named), ["producto", "provincia"], label)
    return usable.withColumns(
        {
            "producto": clean_text(F.col("producto")),
            "provincia": clean_text(F.col("provincia"), title=True),
            "fuente": F.lit(label),
        }
    ).where("producto != '' and provincia != ''")


def source_counts(df: DataFrame, label: str, renames: dict[str, str] | None = None) -> DataFrame:
    """As `prepare_source`, after counting raw spellings, so text is cleaned once per spelling."""
    named = rename_headers(normalise_headers(df, "strip"), RANKING_RENAMES if renames is None else renames)
    usable = require_columns(drop_unnamed(named), ["producto", "provincia"], label)
    spelled = usable.groupBy("producto", "provincia").agg(F.count(F.lit(1)).alias("rows__n"))
    return prepare_source(spelled, label, renames)


def product_province_counts(cells: DataFrame, prefix: str) -> DataFrame:
    """Rows per product and province key with the usual spelling of both names."""
    keyed = cells.withColumns({"producto_key": match_key(F.col("producto")), "provincia_key": match_key(F.col("provincia"))})
    return profile_cells(
        keyed,
        KEYS,
        means={},
        count=f"registros_{prefix}",
        modes={f"producto_{prefix}": "producto", f"provincia_{prefix}": "provincia"},
    )


def joined_counts(producer: DataFrame, market: DataFrame) -> DataFrame:
    zero = {c: 0 for c in ("registros_productor", "registros_mercados")}
    return producer.join(market, KEYS, "full_outer").fillna(zero)


def _both() -> Column:
    return (F.col("registros_productor") > 0) & (F.col("registros_mercados") > 0)


def _most_common_of(name: str) -> Column:
    """Most common non-blank name over rows of equal weight, by a count per name."""
    return F.coalesce(F.mode(F.when(F.trim(name) != "", F.col(name)), deterministic=True), F.lit(""))


def shared_products(merged: DataFrame) -> DataFrame:
    """Products found in both sources with their score, best first.

    The inputs hold one row per product and province.
    """
    rolled = merged.groupBy("producto_key").agg(
        _most_common_of("producto_productor").alias("producto_productor"),
        _most_common_of("producto_mercados").alias("producto_mercados"),
        F.sum("registros_productor").alias("registros_productor"),
        F.sum("registros_mercados").alias("registros_mercados"),
        F.count_if(F.col("registros_productor") > 0).alias("provincias_productor"),
        F.count_if(F.col("registros_mercados") > 0).alias("provincias_mercados"),
        F.count_if(_both()).alias("provincias_en_ambas"),
        F.count_distinct("provincia_key").alias("provincias_union"),
    )
    scored = _with_totals(rolled.where(_both())).withColumn(
        "producto_recomendado", pick_non_blank(F.col("producto_productor"), F.col("producto_mercados"))
    ).withColumn(
        "score_modelado",
        weighted_score(F.col("registros_total"), F.col("registros_balance"), F.col("provincias_en_ambas")),
    )
    return scored.orderBy(
        F.desc("score_modelado"), F.desc("registros_balance"), F.desc("registros_total"), F.asc("producto_recomendado")
    )


def _with_totals(df: DataFrame) -> DataFrame:
    a, b = F.col("registros_productor"), F.col("registros_mercados")
    return df.withColumns({"registros_total": a + b, "registros_balance": F.least(a, b)})


def influential_provinces(merged: DataFrame, ranking: DataFrame, top: int = 5) -> DataFrame:
    """Provinces by their rows for shared products, with their leading products."""
    shared = merged.join(ranking.select("producto_key"), "producto_key", "left_semi")
    named = _with_totals(shared).withColumns(
        {
            "producto_recomendado": pick_non_blank(F.col("producto_productor"), F.col("producto_mercados")),
            "provincia_recomendada": pick_non_blank(F.col("provincia_productor"), F.col("provincia_mercados")),
        }
    )
    rolled = named.groupBy("provincia_key").agg(
        _most_common_of("provincia_recomendada").alias("provincia"),
        F.sum("registros_productor").alias("registros_productor"),
        F.sum("registros_mercados").alias("registros_mercados"),
        F.count_distinct("producto_key").alias("productos_distintos"),
        F.count_if(_both()).alias("productos_en_ambas"),
    )
    scored = _with_totals(rolled).withColumn(
        "score_influencia",
        weighted_score(F.col("registros_total"), F.col("registros_balance"), F.col("productos_en_ambas")),
    )
    totals = named.groupBy("provincia_key", "producto_recomendado").agg(F.sum("registros_total").alias("registros"))
    leaders = leading_values(
        totals, ["provincia_key"], "producto_recomendado",
        [F.desc("registros"), F.asc("producto_recomendado")], top, f"top_{top}_productos",
    )
    return scored.join(leaders, "provincia_key", "left").orderBy(
        F.desc("score_influencia"), F.desc("productos_en_ambas"), F.desc("registros_total"), F.asc("provincia")
    )

"""Feature panel: one plan for all products, provinces and months.

Raw rows are reduced to (product, province, month) cells first; everything after that works on
the panel, whose size depends on the calendar and not on the number of quotes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.constants import (
    BASE_FEATURES, COMMON_START_DATE, FERTILISER_KEY, FULL_FEATURES, MACRO_COLUMNS,
    FERTILISER_COLUMNS, MARKET_CONTEXT_FEATURES, PRODUCER_COLUMNS, TARGET, TARGET_LAG_FEATURES,
    EXOGENOUS_LAGS,
)
from panelmill.functions.dates import add_calendar, add_month_date
from panelmill.functions.headers import drop_unnamed, normalise_headers
from panelmill.functions.numbers import locale_number, percentage
from panelmill.functions.text import clean_text, match_key
from panelmill.operators.grouping import exact_quantiles, partial_cells, profile_cells
from panelmill.operators.windows import ENTITY, add_lag_features, dense_ids, entity_window, forward_fill
from panelmill.session import materialise

CELL = ["product_key", "fecha", "provincia_key"]


def raw_frame(df: DataFrame) -> DataFrame:
    """Normalised headers, without unnamed columns."""
    return drop_unnamed(normalise_headers(df))


def _prices(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text prices parsed; numeric ones left as they are."""
    types = dict(df.dtypes)
    parsed = {c: locale_number(F.col(c)) if types[c] == "string" else F.col(c).cast("double") for c in columns}
    return df.withColumns(parsed)


def _date_columns(df: DataFrame) -> list[str]:
    return ["fecha"] if "fecha" in df.columns else ["ano", "mes"]


def _dated(df: DataFrame) -> DataFrame:
    dated = df if "fecha" in df.columns else add_month_date(df)
    return dated.where(F.col("fecha").isNotNull())


def _keyed(df: DataFrame) -> DataFrame:
    """Cleaned names and their match keys; columns the source lacks are left out."""
    columns = {}
    if "provincia" in df.columns:
        columns["provincia"] = clean_text(F.col("provincia"), title=True)
    if "producto" in df.columns:
        columns["producto"] = clean_text(F.col("producto"))
    cleaned = df.withColumns(columns)
    keys = {}
    if "provincia" in columns:
        keys["provincia_key"] = match_key(F.col("provincia"))
    if "producto" in columns:
        keys["product_key"] = match_key(F.col("producto"))
    return cleaned.withColumns(keys)


def _of_products(df: DataFrame, products: list[str] | None) -> DataFrame:
    return df if products is None else df.where(F.col("product_key").isin(products))


def price_cells(raw: DataFrame, by: list[str], prices: list[str], products: list[str] | None = None) -> DataFrame:
    """Cleaned cells: counts and sums per spelling, then names, keys and dates per cell."""
    priced = _prices(raw_frame(raw), prices)
    cells = partial_cells(priced, [*_date_columns(priced), *by], prices)
    return _of_products(_keyed(_dated(cells)), products)


def market_panel(raw: DataFrame, products: list[str] | None = None) -> DataFrame:
    """Monthly target price and market context per product and province."""
    cells = price_cells(
        raw, ["producto", "provincia", "mercado", "tipo_mercado"],
        ["precio_promedio_usdkg", "promedio_de_precio_usd"], products,
    )
    return profile_cells(
        cells,
        CELL,
        means={TARGET: "precio_promedio_usdkg", "target_precio_mercado_usd": "promedio_de_precio_usd"},
        count="mercados_observaciones",
        modes={"provincia": "provincia", "producto": "producto"},
        distincts={"mercados_distintos": "mercado", "tipos_mercado_distintos": "tipo_mercado"},
    )


def producer_cells(raw: DataFrame, products: list[str] | None = None) -> DataFrame:
    return price_cells(raw, ["producto", "provincia"], ["precio_promedio_usdkg"], products)


def producer_panel(cells: DataFrame) -> DataFrame:
    return profile_cells(
        cells,
        CELL,
        means={"precio_productor_provincia_usdkg": "precio_promedio_usdkg"},
        count="productor_observaciones_provincia",
        modes={"provincia": "provincia", "producto": "producto"},
    )


def producer_national(cells: DataFrame) -> DataFrame:
    return profile_cells(
        cells,
        ["product_key", "fecha"],
        means={"precio_productor_nacional_usdkg": "precio_promedio_usdkg"},
        count="productor_observaciones_nacional",
    )


def input_cells(raw: DataFrame, category: str = FERTILISER_KEY) -> DataFrame:
    """Rows per price, ingredient, province and month of one kind of input."""
    priced = _prices(raw_frame(raw), ["promedio_de_precio"])
    by = [*_date_columns(priced), "provincia", "tipo_insumo", "ingrediente_activo", "promedio_de_precio"]
    cells = priced.groupBy(*by).agg(F.count(F.lit(1)).alias("rows__n"))
    wanted = _dated(cells).where(match_key(F.col("tipo_insumo")) == category)
    price, n = F.col("promedio_de_precio"), F.col("rows__n")
    return _keyed(wanted).withColumns(
        {
            "ingrediente_activo": clean_text(F.col("ingrediente_activo")),
            "promedio_de_precio__sum": price * n,
            "promedio_de_precio__n": F.when(price.isNotNull(), n).otherwise(F.lit(0)),
        }
    )


def _input_series(cells: DataFrame, keys: list[str], where: str, **described) -> DataFrame:
    means = {f"fertilizantes_precio_promedio_{where}": "promedio_de_precio"}
    panel = profile_cells(cells, keys, means, f"fertilizantes_registros_{where}", **described)
    share = {f"fertilizantes_precio_mediano_{where}": 0.5}
    medians = exact_quantiles(cells, keys, "promedio_de_precio", share, weight="rows__n")
    return panel.join(medians, keys, "left")


def input_panel(cells: DataFrame) -> DataFrame:
    return _input_series(
        cells, ["fecha", "provincia_key"], "provincia",
        modes={"provincia": "provincia"},
        distincts={"fertilizantes_ingredientes_activos_provincia": "ingrediente_activo"},
    )


def input_national(cells: DataFrame) -> DataFrame:
    return _input_series(cells, ["fecha"], "nacional")


def assemble_macro(sources: dict[str, DataFrame]) -> DataFrame:
    """Price index with the sector indices joined by month."""
    macro = sources["ipc"]
    for name in ("ibc", "ipm", "ipp_n"):
        macro = macro.join(sources[name], "fecha", "left")
    return macro


def shared_entities(market: DataFrame, producer: DataFrame) -> DataFrame:
    """Market rows of the provinces that also have producer prices for the product."""
    pairs = producer.select(*ENTITY).distinct()
    return market.join(pairs, ENTITY, "left_semi")


def province_ids(market: DataFrame) -> DataFrame:
    """Dense province number per product, in name order, one per province key."""
    named = market.groupBy(*ENTITY).agg(F.min("provincia").alias("provincia__"))
    ids = dense_ids(named.withColumn("name__", F.struct("provincia__", "provincia_key")), ["product_key"], "name__", "provincia_id")
    return ids.select("product_key", F.col("name__.provincia_key").alias("provincia_key"), "provincia_id")


def join_panel(
    market: DataFrame, producer: DataFrame, producer_nat: DataFrame, inputs: DataFrame,
    inputs_nat: DataFrame, macro: DataFrame,
) -> DataFrame:
    """Market panel with all context joined from the left; small national series are broadcast
    by the optimiser when their size allows it."""
    return (
        market.join(producer.drop("provincia", "producto"), CELL, "left")
        .join(inputs.drop("provincia"), ["fecha", "provincia_key"], "left")
        .join(producer_nat, ["product_key", "fecha"], "left")
        .join(inputs_nat, "fecha", "left")
        .join(macro, "fecha", "left")
        .join(province_ids(market), ENTITY, "left")
    )


def fill_exogenous(panel: DataFrame) -> DataFrame:
    """Missing-value flags, fallbacks from province to nation, and forward fills per entity.

    Nothing is filled from a later month.
    """
    spec = entity_window()
    producer, producer_nat = F.col("precio_productor_provincia_usdkg"), F.col("precio_productor_nacional_usdkg")
    mean, mean_nat = (F.col(f"fertilizantes_precio_promedio_{w}") for w in ("provincia", "nacional"))
    median, median_nat = (F.col(f"fertilizantes_precio_mediano_{w}") for w in ("provincia", "nacional"))
    any_macro = F.lit(False)
    for c in MACRO_COLUMNS:
        any_macro = any_macro | F.col(c).isNull()
    flagged = panel.withColumns(
        {
            "productor_missing_exact": producer.isNull().cast("int"),
            "fertilizantes_missing_exact": mean.isNull().cast("int"),
            "macro_missing_any": any_macro.cast("int"),
            "precio_productor_usdkg_filled": forward_fill(F.coalesce(producer, producer_nat), spec),
            "fertilizantes_precio_promedio_filled": forward_fill(F.coalesce(mean, mean_nat), spec),
            **{c: forward_fill(F.col(c), spec) for c in MACRO_COLUMNS},
        }
    )
    producer_filled = F.col("precio_productor_usdkg_filled")
    mean_filled = F.col("fertilizantes_precio_promedio_filled")
    counts = [
        "productor_observaciones_provincia", "productor_observaciones_nacional",
        "fertilizantes_registros_provincia", "fertilizantes_registros_nacional",
        "fertilizantes_ingredientes_activos_provincia",
    ]
    return flagged.withColumns(
        {
            "precio_productor_provincia_usdkg": F.coalesce(producer, producer_filled),
            "precio_productor_nacional_usdkg": F.coalesce(producer_nat, producer_filled),
            "fertilizantes_precio_promedio_provincia": F.coalesce(mean, mean_filled),
            "fertilizantes_precio_promedio_nacional": F.coalesce(mean_nat, mean_filled),
            "fertilizantes_precio_mediano_provincia": F.coalesce(median, median_nat),
            "fertilizantes_precio_mediano_nacional": F.coalesce(median_nat, median),
            **{c: F.coalesce(c, F.lit(0)) for c in counts},
        }
    )


def complete_rows(features: DataFrame) -> DataFrame:
    """Rows where the target and all features are known."""
    return features.dropna(subset=[TARGET, *FULL_FEATURES])


DATASET_COLUMNS = [
    "product_key", "fecha", "provincia_key", "provincia", "producto", TARGET, "target_precio_mercado_usd",
    *MARKET_CONTEXT_FEATURES, *PRODUCER_COLUMNS, *FERTILISER_COLUMNS, *MACRO_COLUMNS, "macro_missing_any",
    "provincia_id", "anio", "mes_num", "trimestre", "mes_sin", "mes_cos", *TARGET_LAG_FEATURES, *EXOGENOUS_LAGS,
]


def as_is(df: DataFrame, name: str) -> DataFrame:
    return df


class PanelInputs:
    """Panels of all sources for one set of raw frames.

    Each raw source is read once: its cells, which several panels use, are staged as a table
    in the scratch folder when first needed. Pass `stage=as_is` to keep everything lazy.
    """

    def __init__(
        self, market: DataFrame, producer: DataFrame, inputs: DataFrame, macro: dict[str, DataFrame],
        category: str = FERTILISER_KEY, start: str = COMMON_START_DATE, products: list[str] | None = None,
        stage: Callable[[DataFrame, str], DataFrame] = materialise,
    ):
        self._market, self._producer, self._inputs, self._macro = market, producer, inputs, macro
        self._category, self._start, self._products, self._stage = category, start, products, stage

    @cached_property
    def producer_rows(self) -> DataFrame:
        return self._stage(producer_cells(self._producer, self._products), "producer-cells")

    @cached_property
    def input_rows(self) -> DataFrame:
        return self._stage(input_cells(self._inputs, self._category), "input-cells")

    @cached_property
    def macro(self) -> DataFrame:
        return self._stage(assemble_macro(self._macro), "macro")

    @cached_property
    def market(self) -> DataFrame:
        """Market panel of the shared provinces from the common start on."""
        shared = shared_entities(market_panel(self._market, self._products), self.producer_rows)
        return self._stage(shared.where(F.col("fecha") >= F.lit(self._start).cast("date")), "market-panel")

    @cached_property
    def producer(self) -> DataFrame:
        return producer_panel(self.producer_rows)

    @cached_property
    def producer_nat(self) -> DataFrame:
        return producer_national(self.producer_rows)

    @cached_property
    def inputs(self) -> DataFrame:
        return input_panel(self.input_rows)

    @cached_property
    def inputs_nat(self) -> DataFrame:
        return input_national(self.input_rows)

    def joined(self) -> DataFrame:
        return join_panel(self.market, self.producer, self.producer_nat, self.inputs, self.inputs_nat, self.macro)

    def wide(self) -> DataFrame:
        """All rows with features, before incomplete ones are dropped."""
        filled = fill_exogenous(add_calendar(self.joined()))
        return add_lag_features(filled).select(*DATASET_COLUMNS)

    def dataset(self) -> DataFrame:
        return complete_rows(self.wide())


def is_complete() -> Column:
    complete = F.lit(True)
    for c in [TARGET, *FULL_FEATURES]:
        complete = complete & F.col(c).isNotNull()
    return complete


def preprocessing_summary(wide: DataFrame) -> DataFrame:
    """Rows dropped and imputed per product, from one pass over the panel."""
    complete = is_complete()

    def flagged(c: str) -> Column:
        return F.coalesce(F.sum(F.when(complete, F.col(c))), F.lit(0))

    counts = wide.groupBy("product_key").agg(
        F.count(F.lit(1)).alias("registros_iniciales"),
        F.count_if(complete).alias("registros_finales"),
        flagged("productor_missing_exact").alias("productor_imputado"),
        flagged("fertilizantes_missing_exact").alias("fertilizantes_imputado"),
        flagged("macro_missing_any").alias("macro_completado"),
    )
    first, final = F.col("registros_iniciales"), F.col("registros_finales")
    return counts.select(
        "product_key",
        "registros_iniciales",
        (first - final).alias("registros_eliminados"),
        percentage(first - final, first).alias("pct_eliminado"),
        "productor_imputado",
        percentage(F.col("productor_imputado"), final).alias("pct_productor_imputado"),
        "fertilizantes_imputado",
        percentage(F.col("fertilizantes_imputado"), final).alias("pct_fertilizantes_imputado"),
        "macro_completado",
        percentage(F.col("macro_completado"), final).alias("pct_macro_completado"),
        "registros_finales",
    )


def dataset_metadata(wide: DataFrame) -> DataFrame:
    """One metadata document per product as nested columns, ready for a JSON sink."""
    complete = is_complete()
    rows = F.count(F.lit(1))
    exact = F.count_if(F.col("productor_missing_exact") == 0)
    facts = wide.groupBy("product_key").agg(
        F.min("producto").alias("product_name"),
        rows.alias("rows_before_lag_drop"),
        F.count_if(complete).alias("rows_final_dataset"),
        F.date_format(F.min(F.when(complete, F.col("fecha"))), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max(F.when(complete, F.col("fecha"))), "yyyy-MM-dd").alias("date_max"),
        F.array_sort(F.collect_set("provincia")).alias("shared_provinces"),
        exact.alias("productor_exact_match_rows"),
        F.round(exact / rows, 4).alias("productor_exact_match_pct"),
    )

    def names(columns) -> Column:
        return F.array(*[F.lit(c) for c in columns])

    groups = F.struct(
        names(["fecha", "producto", "provincia", "provincia_id", "anio", "mes_num", "trimestre"]).alias("identifiers"),
        names([TARGET, "target_precio_mercado_usd"]).alias("target"),
        names(MARKET_CONTEXT_FEATURES).alias("market_context"),
        names(PRODUCER_COLUMNS).alias("producer_features"),
        names(FERTILISER_COLUMNS).alias("agro_features"),
        names(MACRO_COLUMNS).alias("macro_features"),
        names(["mes_sin", "mes_cos"]).alias("temporal_features"),
        names([*TARGET_LAG_FEATURES, *EXOGENOUS_LAGS]).alias("lag_features"),
    )
    summary = preprocessing_summary(wide)
    packed = summary.select("product_key", F.struct(*[c for c in summary.columns if c != "product_key"]).alias("preprocessing_summary"))
    return facts.join(packed, "product_key").withColumns(
        {
            "target_column": F.lit(TARGET),
            "date_column": F.lit("fecha"),
            "entity_columns": names(["provincia"]),
            "shared_provinces_count": F.size("shared_provinces"),
            "feature_groups": groups,
            "recommended_model_features": names(FULL_FEATURES),
            "base_model_features": names(BASE_FEATURES),
            "full_model_features": names(FULL_FEATURES),
        }
    )

"""Temporal splits, folds, the month spine and sequence windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.common import (
    BOUNDS, DATASET, MACRO, SHARED, evaluation, holdout_sql, inputs, market_series, query, rounded, sql_round, sql_rounded,
)
from panelmill.constants import TARGET
from panelmill.operators import splits
from panelmill.operators.summaries import fit_ranges, scale_columns
from panelmill.operators.windows import ENTITY, last_row, sequence_windows
from panelmill.sources import driver_tables as dt

KEYS = ["product_key", "provincia_key", "fecha"]
KEY_SQL = ", ".join(KEYS)
SEQUENCE = ["y_scaled", "mes_scaled"]


def holdout_cutoffs(spark, sf):
    return splits.holdout_cutoffs(market_series(spark, sf))


def holdout_split(spark, sf):
    series = market_series(spark, sf)
    return splits.apply_cutoffs(series, splits.holdout_cutoffs(series)).select(*KEYS, "cutoff", "split")


def positional_split(spark, sf):
    return splits.nested_split(market_series(spark, sf)).select(*KEYS, "split", "part")


def series_split(spark, sf):
    return rounded(splits.series_split(dt.macro_sources(spark, sf)["ipc"]).select("fecha", "split", "ipc_alimentos"))


def split_check(spark, sf):
    """Entities per product whose split is valid or not."""
    split = splits.holdout(market_series(spark, sf))
    bad = splits.split_violations(split).groupBy("product_key").agg(F.count(F.lit(1)).alias("bad"))
    entities = split.groupBy("product_key").agg(
        F.count_distinct("provincia_key").alias("entities"), F.count_if(F.col("split") == "test").alias("test_rows")
    )
    return entities.join(bad, "product_key", "left").withColumn("bad", F.coalesce("bad", F.lit(0)))


def expanding_folds(spark, sf):
    ev = evaluation(spark, sf)
    folded = splits.assign_folds(ev.train, ev.bounds)
    return folded.groupBy("product_key", "fold", "windows", "train_end").agg(
        F.count(F.lit(1)).alias("val_rows"), F.count_distinct("provincia_key").alias("entities"),
        F.min("fecha").alias("first"), F.max("fecha").alias("last"),
    )


def fold_bounds(spark, sf):
    return evaluation(spark, sf).bounds


def entity_folds(spark, sf):
    ev = evaluation(spark, sf)
    cutoffs = ev.split.select(*ENTITY, "cutoff").distinct()
    return splits.entity_folds(ev.bounds, cutoffs).select(*ENTITY, "cutoff", "fold", "train_end", "val_end")


def month_spine(spark, sf):
    series = market_series(spark, sf)
    return rounded(splits.month_spine(series, [TARGET]))


def last_known_rows(spark, sf):
    return rounded(last_row(market_series(spark, sf), ENTITY))


def _scaled(spark, sf):
    split = splits.holdout(market_series(spark, sf)).select(
        *KEYS, "split", F.col(TARGET).alias("y_scaled"), F.month("fecha").cast("double").alias("mes_scaled")
    )
    ranges = fit_ranges(split.where("split = 'train'"), SEQUENCE, ["product_key"])
    return scale_columns(split, ranges, SEQUENCE, ["product_key"])


def train_scaler_ranges(spark, sf):
    split = splits.holdout(market_series(spark, sf))
    return rounded(fit_ranges(split.where("split = 'train'"), [TARGET], ["product_key"]))


def sequence_windows_panel(spark, sf):
    windows = sequence_windows(_scaled(spark, sf), SEQUENCE, 8)
    flat = F.flatten("window")
    return rounded(windows.select(
        *KEYS, "split", F.size(flat).cast("long").alias("size"), flat[0].alias("oldest"), flat[14].alias("newest"),
        F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("total"),
    ))


def sequence_windows_legacy(spark, sf):
    series = market_series(spark, sf)
    windows = sequence_windows(series, [TARGET], 6, include_current=False)
    flat = F.flatten("window")
    return rounded(windows.select(*KEYS, flat[0].alias("oldest"), flat[5].alias("newest")))


def scaled_series(spark, sf):
    """National series on a common 0-1 scale."""
    macro = inputs(spark, sf).macro
    columns = ["ipc_alimentos", "ibc", "ipm"]
    return rounded(scale_columns(macro, fit_ranges(macro, columns), columns).select("fecha", *columns), 7)


QUERIES = {
    f.__name__: f
    for f in (
        holdout_cutoffs, holdout_split, positional_split, series_split, split_check, expanding_folds, fold_bounds,
        entity_folds, month_spine, last_known_rows, train_scaler_ranges, sequence_windows_panel,
        sequence_windows_legacy, scaled_series,
    )
}

SERIES_SPLIT = f"{SHARED},{holdout_sql('market_panel')}"
FOLDS = f"{DATASET},{holdout_sql()},{BOUNDS}"
W = "OVER (PARTITION BY product_key, provincia_key ORDER BY fecha)"

ORACLES = {
    "holdout_cutoffs": query(SERIES_SPLIT, "SELECT product_key, provincia_key, cutoff FROM cut"),
    "holdout_split": query(SERIES_SPLIT, f"SELECT {KEY_SQL}, cutoff, split FROM split"),
    "positional_split": query(
        f"""{SHARED},
a AS (SELECT *, row_number() {W} AS place, count(*) OVER (PARTITION BY product_key, provincia_key) AS n FROM market_panel),
b AS (SELECT *, greatest(1, least(CAST(floor(n * 0.8::DOUBLE) AS BIGINT), n - 1)) AS k FROM a),
c AS (SELECT *, greatest(1, least(CAST(floor(k * 0.8::DOUBLE) AS BIGINT), k - 1)) AS j FROM b)""",
        f"""SELECT {KEY_SQL}, CASE WHEN place <= k THEN 'train' ELSE 'test' END AS split,
       CASE WHEN place <= j THEN 'fit' WHEN place <= k THEN 'validation' ELSE 'test' END AS part FROM c""",
    ),
    "series_split": query(
        MACRO,
        f"""SELECT fecha, CASE WHEN row_number() OVER (ORDER BY fecha) <= floor(count(*) OVER () * 0.8::DOUBLE)
                           THEN 'train' ELSE 'test' END AS split, {sql_round(['ipc_alimentos'])} FROM macro""",
    ),
    "split_check": query(
        SERIES_SPLIT,
        """SELECT product_key, count(DISTINCT provincia_key) AS entities, count(*) FILTER (split = 'test') AS test_rows,
       0::BIGINT AS bad FROM split GROUP BY 1""",
    ),
    "expanding_folds": query(
        FOLDS,
        """SELECT s.product_key, fold, windows, train_end, count(*) AS val_rows,
       count(DISTINCT provincia_key) AS entities, min(fecha) AS first, max(fecha) AS last
FROM split s JOIN bounds b ON b.product_key = s.product_key AND s.fecha BETWEEN val_start AND val_end
WHERE split = 'train' GROUP BY ALL""",
    ),
    "fold_bounds": query(FOLDS, "SELECT product_key, fold, windows, train_end, val_start, val_end FROM bounds"),
    "entity_folds": query(
        FOLDS,
        """SELECT product_key, provincia_key, cutoff, fold, train_end, val_end
FROM cut JOIN bounds USING (product_key) WHERE val_end < cutoff""",
    ),
    "month_spine": query(
        f"""{SHARED},
span AS (SELECT product_key, provincia_key, min(fecha) AS a, max(fecha) AS b FROM market_panel GROUP BY 1, 2),
spine AS (SELECT product_key, provincia_key,
                 CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS fecha FROM span),
full_series AS (SELECT s.*, m.{TARGET} FROM spine s LEFT JOIN market_panel m USING (product_key, provincia_key, fecha))""",
        f"""SELECT {KEY_SQL}, {TARGET} IS NOT NULL AS observed,
       {sql_rounded(f'last_value({TARGET} IGNORE NULLS) {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS {TARGET}
FROM full_series""",
    ),
    "last_known_rows": query(
        SHARED,
        f"""SELECT {KEY_SQL}, provincia, producto, {sql_round([TARGET])} FROM market_panel
QUALIFY row_number() OVER (PARTITION BY product_key, provincia_key ORDER BY fecha DESC) = 1""",
    ),
    "train_scaler_ranges": query(
        SERIES_SPLIT,
        f"""SELECT product_key, {sql_rounded(f'min({TARGET})')} AS {TARGET}__low, {sql_rounded(f'max({TARGET})')} AS {TARGET}__high
FROM split WHERE split = 'train' GROUP BY 1""",
    ),
    "sequence_windows_panel": query(
        f"""{SERIES_SPLIT},
ranges AS (SELECT product_key, min({TARGET}) AS a, max({TARGET}) AS b, min(month(fecha)) AS c, max(month(fecha)) AS d
           FROM split WHERE split = 'train' GROUP BY 1),
scaled AS (SELECT {KEY_SQL}, split, ({TARGET} - a) / (b - a) AS y, (month(fecha) - c) / (d - c) AS m
           FROM split JOIN ranges USING (product_key)),
seq AS (SELECT *, row_number() {W} AS place, lag(y, 7) {W} AS oldest,
               sum(y) {W[:-1]} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
               + sum(m) {W[:-1]} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS total FROM scaled)""",
        f"""SELECT {KEY_SQL}, split, 16::BIGINT AS size, {sql_rounded('oldest')} AS oldest, {sql_rounded('y')} AS newest,
       {sql_rounded('total')} AS total FROM seq WHERE place >= 8""",
    ),
    "sequence_windows_legacy": query(
        SHARED,
        f"""SELECT {KEY_SQL}, {sql_rounded(f'lag({TARGET}, 6) {W}')} AS oldest, {sql_rounded(f'lag({TARGET}, 1) {W}')} AS newest
FROM market_panel QUALIFY row_number() {W} > 6""",
    ),
    "scaled_series": query(
        MACRO,
        "SELECT fecha, "
        + ", ".join(
            sql_rounded(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())", 7) + f" AS {c}"
            for c in ("ipc_alimentos", "ibc", "ipm")
        )
        + " FROM macro",
    ),
}

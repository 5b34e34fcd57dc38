"""Drift and performance reports between a reference and a current frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.constants import MIN_REPORT_ROWS
from panelmill.operators.grouping import exact_quantiles, running_totals
from panelmill.operators.metrics import metric_columns, with_direction
from panelmill.session import materialise

EMPTY_SHARE = 1e-4


def attach_predictions(features: DataFrame, predictions: DataFrame, key: list[str]) -> DataFrame:
    """Feature rows with their target and prediction, matched by key."""
    return features.join(
        predictions.select(*key, F.col("y_true").alias("target"), F.col("y_pred").alias("prediction")), key
    )


def _labelled(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    def cells(df: DataFrame, which: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
        return df.select(F.inline(pairs)).where("value is not null").withColumn("which", F.lit(which))

    both = cells(reference, "reference").unionByName(cells(current, "current"))
    counts = [F.count_if(F.col("which") == w).alias(f"n_{w}") for w in ("reference", "current")]
    return both.groupBy("column", "value").agg(*counts)


def ks_statistics(by_value: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per column and its large-sample p-value."""
    totals = by_value.groupBy("column").agg(F.sum("n_reference").alias("m"), F.sum("n_current").alias("k"))
    upto = running_totals(by_value, ["column"], "value", ["n_reference", "n_current"])
    gap = F.abs(F.col("n_reference__upto") / F.col("m") - F.col("n_current__upto") / F.col("k"))
    distance = upto.join(totals, "column").groupBy("column").agg(
        F.max("m").alias("n_reference"), F.max("k").alias("n_current"), F.max(gap).alias("ks")
    )
    scaled = F.col("ks") * F.sqrt(F.col("n_reference") * F.col("n_current") / (F.col("n_reference") + F.col("n_current")))
    def add_term(total: Column, j: Column) -> Column:
        sign = F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        return total + sign * F.exp(-2.0 * j * j * F.col("scaled__") * F.col("scaled__"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), add_term)
    p_value = F.when(F.col("scaled__") < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return distance.withColumn("scaled__", scaled).withColumn("ks_p_value", p_value).drop("scaled__")


def stability_index(by_value: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index over bins cut at the reference deciles."""
    shares = {f"e{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(by_value.where("n_reference > 0"), ["column"], "value", shares, weight="n_reference")
    listed = edges.select("column", F.array(*shares).alias("edges"))
    binned = by_value.join(listed, "column").withColumn(
        "bin", F.size(F.filter("edges", lambda e: e < F.col("value")))
    )
    per_bin = binned.groupBy("column", "bin").agg(F.sum("n_reference").alias("r"), F.sum("n_current").alias("c"))
    totals = per_bin.groupBy("column").agg(F.sum("r").alias("m"), F.sum("c").alias("k"))
    a = F.greatest(F.col("r") / F.col("m"), F.lit(EMPTY_SHARE))
    b = F.greatest(F.col("c") / F.col("k"), F.lit(EMPTY_SHARE))
    return per_bin.join(totals, "column").groupBy("column").agg(F.sum((b - a) * F.log(b / a)).alias("psi"))


def drift_report(
    reference: DataFrame, current: DataFrame, columns: list[str], alpha: float = 0.05
) -> DataFrame:
    """Per column: sample sizes, KS distance and p-value, PSI and a drift verdict, and the share
    of columns that drifted. The counts per distinct value are staged, since both statistics
    read them several times."""
    by_value = materialise(_labelled(reference, current, columns), "value-counts")
    report = ks_statistics(by_value).join(stability_index(by_value), "column")
    judged = report.withColumn("drifted", F.col("ks_p_value") < alpha)
    all_columns = Window.partitionBy()  # one row per column of the frame
    return judged.withColumn("drifted_share", F.avg(F.col("drifted").cast("double")).over(all_columns))


def performance_report(reference: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Metrics and error moments of both frames; groups with too few current rows are skipped."""
    error = F.col("y_pred") - F.col("y_true")

    def scored(df: DataFrame, which: str) -> DataFrame:
        directed = with_direction(df, by, ["product_id", "provincia"])
        return directed.groupBy(*by).agg(
            *metric_columns(), F.avg(error).alias("mean_error"), F.stddev_samp(error).alias("std_error")
        ).withColumn("which", F.lit(which))

    now = scored(current, "current").where(F.col("n_test") >= MIN_REPORT_ROWS)
    before = scored(reference, "reference").join(now.select(*by), by, "left_semi")
    return before.unionByName(now)

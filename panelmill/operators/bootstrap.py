"""Moving-block bootstrap over entities, and the correction for many comparisons.

A replica never builds resampled rows. Each entity keeps prefix sums of its squared errors, so a
drawn block costs one subtraction, and replicas are added up on the map side. The draws come
from a hash of (seed, replica, product, entity, slot): the same in any partitioning and on retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.constants import BLOCK_MONTHS, CONFIDENCE, REPLICAS, SEED
from panelmill.operators.comparison import common_window
from panelmill.operators.grouping import running_totals
from panelmill.session import materialise, spread


def _draw(seed: int, slot: Column, choices: Column) -> Column:
    text = F.concat_ws(
        "|", F.lit(str(seed)), F.col("replica").cast("string"), "product_id", "provincia", slot.cast("string")
    )
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % choices


def _prefix_sums(errors: Column) -> Column:
    """Array with 0 and then the running sums of the errors of one entity's few months."""
    return F.aggregate(
        errors,
        F.array(F.lit(0.0)),
        lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + e)),
    )


def entity_errors(matched: DataFrame, series: str) -> DataFrame:
    """Per product and entity: test length and, per series, prefix sums of squared errors."""
    squared = (F.col("y_true") - F.col("y_pred")) * (F.col("y_true") - F.col("y_pred"))
    listed = F.array_sort(F.collect_list(F.struct("fecha", squared.alias("e"))))
    per_series = spread(matched, ["product_id", "provincia"]).groupBy("product_id", "provincia", F.col(series).alias("series")).agg(
        F.transform(listed, lambda x: x["e"]).alias("errors")
    )
    return (
        per_series.withColumn("sums", _prefix_sums(F.col("errors")))
        .groupBy("product_id", "provincia")
        .agg(
            F.max(F.size("errors")).cast("bigint").alias("n"),
            F.collect_list(F.struct("series", "sums")).alias("all_series"),
        )
    )


def replica_rmse(
    matched: DataFrame, series: str, replicas: int = REPLICAS, block: int = BLOCK_MONTHS, seed: int = SEED
) -> DataFrame:
    """(product_id, series, replica, rmse): every series of a product shares the draws.

    Entities not longer than a block are resampled row by row.
    """
    n = F.col("n")
    length = F.when(n <= block, F.lit(1)).otherwise(F.lit(block)).cast("bigint")
    slots = F.sequence(F.lit(0).cast("bigint"), F.ceil(n / length) - 1)
    drawn = (
        entity_errors(matched, series)
        .withColumn("length", length)
        .withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas))))
        .withColumn(
            "blocks",
            F.transform(
                slots,
                lambda s: F.struct(
                    _draw(seed, s, n - F.col("length") + 1).alias("start"),
                    F.least(F.col("length"), n - s * F.col("length")).alias("taken"),
                ),
            ),
        )
        .select("product_id", "n", "replica", "blocks", F.inline("all_series"))
    )
    def add_block(total: Column, b: Column) -> Column:
        first = (b["start"] + 1).cast("int")
        last = (b["start"] + b["taken"] + 1).cast("int")
        return total + F.element_at("sums", last) - F.element_at("sums", first)

    sse = drawn.withColumn("sse", F.aggregate("blocks", F.lit(0.0), add_block))
    pooled = sse.groupBy("product_id", "series", "replica").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    # prefix differences may leave a tiny negative remainder for a zero sum
    return pooled.select(
        "product_id", "series", "replica", F.sqrt(F.greatest(F.col("sse"), F.lit(0.0)) / F.col("n")).alias("rmse")
    )


def _tails(confidence: float) -> list[float]:
    return [(1 - confidence) / 2, (1 + confidence) / 2]


def reflected_interval(
    replicas: DataFrame, points: DataFrame, by: list[str], value: str, confidence: float = CONFIDENCE
) -> DataFrame:
    """Pivotal interval and two-sided p-value of `value` around its point estimate."""
    low, high = _tails(confidence)
    joined = replicas.join(points, by).withColumn("mirror", 2 * F.col("point") - F.col(value))
    stats = joined.groupBy(*by).agg(
        F.max("point").alias("point"),
        F.max("n").alias("n"),
        F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q"),
        F.avg((F.col("mirror") <= 0).cast("double")).alias("below"),
        F.avg((F.col("mirror") >= 0).cast("double")).alias("above"),
    )
    return stats.select(
        *by,
        "n",
        "point",
        (2 * F.col("point") - F.col("q")[1]).alias("lower"),
        (2 * F.col("point") - F.col("q")[0]).alias("upper"),
        F.least(F.lit(1.0), 2 * F.least("below", "above")).alias("p_value"),
    )


def _points(matched: DataFrame, series: str) -> DataFrame:
    error = F.col("y_true") - F.col("y_pred")
    return matched.groupBy("product_id", F.col(series).alias("series")).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n")
    )


def rmse_intervals(predictions: DataFrame, replicas: int = REPLICAS, confidence: float = CONFIDENCE, **options) -> DataFrame:
    """RMSE of each model on the common window with its bootstrap interval."""
    matched = common_window(predictions)
    draws = replica_rmse(matched, "model_name", replicas, **options)
    points = _points(matched, "model_name").withColumnRenamed("rmse", "point")
    found = reflected_interval(draws, points, ["product_id", "series"], "rmse", confidence)
    return found.select(
        "product_id",
        F.col("series").alias("model_name"),
        "n",
        F.col("point").alias("rmse_bootstrap_mean"),
        F.greatest(F.lit(0.0), "lower").alias("rmse_ci_lower"),
        F.col("upper").alias("rmse_ci_upper"),
        F.lit(confidence).alias("confidence"),
        F.lit(options.get("block", BLOCK_MONTHS)).alias("block_size_months"),
    )


def _differences(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    a = left.select(*on, F.col("series").alias("series_a"), F.col("rmse").alias("rmse_a"), *[c for c in ["n"] if c in left.columns])
    b = right.select(*on, F.col("series").alias("series_b"), F.col("rmse").alias("rmse_b"))
    return a.join(b, on).where("series_a < series_b").withColumn("delta", F.col("rmse_a") - F.col("rmse_b"))


def paired_difference(
    matched: DataFrame, series: str, replicas: int = REPLICAS, confidence: float = CONFIDENCE, **options
) -> DataFrame:
    """RMSE(a) - RMSE(b) for each ordered pair of series, with interval, verdict and p-value.

    Pairs are formed on replica totals, so the join is as large as models x replicas.
    """
    draws = replica_rmse(matched, series, replicas, **options)
    by = ["product_id", "series_a", "series_b"]
    deltas = _differences(draws, draws, ["product_id", "replica"])
    points = _differences(_points(matched, series), _points(matched, series), ["product_id"])
    points = points.select(*by, F.col("delta").alias("point"), "n")
    found = reflected_interval(deltas.select(*by, "delta"), points, by, "delta", confidence)
    significant = ~((F.col("lower") <= 0) & (F.col("upper") >= 0))
    return found.withColumn("significant", significant)


def holm_bonferroni(df: DataFrame, p_value: str, alias: str, alpha: float = 1 - CONFIDENCE) -> DataFrame:
    """Step-down verdicts over the whole family of comparisons.

    Equal p-values share their verdict, and everything from the first failing value on fails, so
    ranks are only needed per distinct p-value and the family itself is never sorted.
    """
    counts = df.groupBy(F.col(p_value).alias("p__")).agg(F.count(F.lit(1)).alias("n"))
    size = df.agg(F.count(F.lit(1))).scalar()
    ranked = running_totals(counts, [], "p__", ["n"])
    before = F.col("n__upto") - F.col("n")
    failing = ranked.where(F.col("p__") > F.lit(alpha) / (size - before)).agg(F.min("p__")).scalar()
    return df.withColumn(alias, F.col(p_value) < F.coalesce(failing, F.lit(float("inf"))))


def _verdicts(found: DataFrame, names: dict[str, str], delta: str) -> DataFrame:
    table = found.select(
        "product_id",
        *[F.col(old).alias(new) for old, new in names.items()],
        "n",
        F.col("point").alias(delta),
        F.col("lower").alias("delta_ci_lower"),
        F.col("upper").alias("delta_ci_upper"),
        F.col("significant").alias("significant_95"),
        F.col("p_value").alias("p_value_bootstrap"),
    )
    return holm_bonferroni(materialise(table, "comparisons"), "p_value_bootstrap", "significant_holm")


def pairwise_significance(predictions: DataFrame, replicas: int = REPLICAS, **options) -> DataFrame:
    """Every pair of models of a product on their common window."""
    found = paired_difference(common_window(predictions), "model_name", replicas, **options)
    names = {"series_a": "model_a", "series_b": "model_b"}
    return _verdicts(found, names, "delta_rmse_a_minus_b")


def paired_feature_sets(predictions: DataFrame) -> DataFrame:
    """Base and full predictions of the same model and row, side by side."""
    key = ["product_id", "model_name", "provincia", "fecha"]
    both = (
        predictions.groupBy(*key)
        .pivot("feature_set", ["base", "full"])
        .agg(F.first("y_true").alias("y_true"), F.first("y_pred").alias("y_pred"))
    )
    names = {f"{s}_{c}": f"{c}_{s}" for s in ("base", "full") for c in ("y_true", "y_pred")}
    return both.withColumnsRenamed(names).where("y_pred_base is not null and y_pred_full is not null")


def ablation_significance(predictions: DataFrame, replicas: int = REPLICAS, **options) -> DataFrame:
    """Each model against itself, base versus full."""
    sides = F.array(
        *[F.struct(F.lit(s).alias("feature_set"), F.col(f"y_pred_{s}").alias("y_pred")) for s in ("base", "full")]
    )
    rows = paired_feature_sets(predictions).select(
        F.concat_ws("|", "product_id", "model_name").alias("product_id"),
        "provincia", "fecha", F.col("y_true_full").alias("y_true"), F.inline(sides),
    )
    found = paired_difference(rows, "feature_set", replicas, **options)
    split = F.split("product_id", r"\|")
    named = found.withColumn("model_name", F.element_at(split, -1)).withColumn(
        "product_id", F.array_join(F.slice(split, 1, F.size(split) - 1), "|")
    )
    return _verdicts(named, {"model_name": "model_name"}, "delta_rmse_base_minus_full")

"""Result store: partitioned tables for predictions and metrics, CSV and JSON sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.constants import FEATURES_BY_SET, TARGET
from panelmill.operators.contracts import enforce_dataset, validate_dataset

KEYS = ["product_id", "model_name", "feature_set"]


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, encoding="UTF-8").csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """Globally sorted files: ranges of the order go to numbered files, and each file is sorted."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Rows of `write_ordered` with `position` (from 1) in file order: counts per file give each its first
    position, so nothing is sorted again."""
    rows = spark.read.parquet(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file__"), F.col("_metadata.row_index").alias("row__"))
    counts = rows.groupBy("file__").agg(F.count(F.lit(1)).alias("n__"))
    before = Window.orderBy("file__").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    first = counts.select("file__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("first__"))
    return rows.join(first, "file__").withColumn("position", F.col("first__") + F.col("row__") + 1).drop("file__", "row__", "first__")


def write_artifact(df: DataFrame, path: str, kind: str) -> None:
    """One kind of metrics below `path`, with whatever columns it has."""
    df.write.mode("overwrite").parquet(f"{path}/kind={kind}")


def scan_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """All metrics below `path`, by name: a column that a kind lacks is null there."""
    return spark.read.option("mergeSchema", True).parquet(path)


def read_json(spark: SparkSession, path: str, schema=None, one_per_file: bool = False) -> DataFrame:
    """JSON documents, one per line as `save_json` writes them or one per file."""
    reader = spark.read.option("multiLine", one_per_file)
    return (reader.schema(schema) if schema else reader).json(path)


def write_results(df: DataFrame, path: str) -> None:
    """Replaces the (product, model, feature set) parts that `df` holds and keeps all others."""
    (
        df.repartition(*KEYS, "provincia" if "provincia" in df.columns else KEYS[0])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*KEYS)
        .parquet(path)
    )


def read_results(
    spark: SparkSession, path: str, product_id: str | None = None, feature_set: str | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """Results of all artifacts, or of the partitions asked for; absent ones are simply not there."""
    df = spark.read.parquet(path)
    for column, wanted in (("product_id", product_id), ("feature_set", feature_set), ("model_name", model_name)):
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df


@dataclass
class FeatureBundle:
    """A validated dataset with the columns a model reads."""

    data: DataFrame
    features: list[str]
    target: str
    date: str
    feature_set: str


def feature_list(metadata: dict | None, feature_set: str) -> list[str]:
    """Features named by the metadata, by its recommended list, or by the fixed sets."""
    if feature_set not in FEATURES_BY_SET:
        raise ValueError(f"unknown feature set {feature_set!r}")
    if metadata is None:
        return list(FEATURES_BY_SET[feature_set])
    return list(metadata.get(f"{feature_set}_model_features", metadata.get("recommended_model_features", [])))


def load_bundle(df: DataFrame, feature_set: str = "full", metadata: dict | None = None, check: bool | str = True) -> FeatureBundle:
    """The dataset with its features. `check` tests the contract at once, or in the plan if it is "plan"."""
    metadata = metadata or {}
    features = feature_list(metadata or None, feature_set)
    target = metadata.get("target_column", TARGET)
    date = metadata.get("date_column", "fecha")
    dated = df.withColumn(date, F.col(date).try_cast("date"))
    if check:
        dated = (enforce_dataset if check == "plan" else validate_dataset)(dated, features, target, date)
    return FeatureBundle(dated, features, target, date, feature_set)


def metadata_rollup(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """One row per product from the metadata documents under `path`."""
    return read_json(spark, path, one_per_file=one_per_file).select("product_key", "product_name", "preprocessing_summary.*")

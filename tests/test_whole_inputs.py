from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelmill import constants
from panelmill.catalog import common

SF = "/root/testdata/sf0.001"


def test_panels_start_with_the_data(spark):
    first = spark.read.parquet(f"{SF}/lineitem.parquet").agg(F.min(F.trunc("l_shipdate", "month"))).first()[0]
    market = common.inputs(spark, SF).market
    assert market.agg(F.min("fecha")).first()[0].year == first.year
    shared = entry.oracle_sql()["feature_dataset"]
    assert "1996" not in shared and "1996-01-01" in entry.oracle_sql()["legacy_series_features"]


def test_full_history_and_replicas(spark):
    assert common.evaluation(spark, SF).min_rows == constants.MIN_ENTITY_ROWS
    sql = entry.oracle_sql()
    assert f"entity_rows >= {constants.MIN_ENTITY_ROWS}" in sql["regression_metrics"]
    for name in ("block_bootstrap_ci", "pairwise_significance", "ablation_significance"):
        assert f"range(1, {constants.REPLICAS + 1})" in sql[name]

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import compare

SF = "/root/testdata/sf0.001"
SAMPLE = ["market_panel", "input_price_panel", "feature_dataset", "month_spine", "regression_metrics", "pairwise_significance",
          "recursive_horizons", "province_ranking", "price_drift", "clean_text_keys", "document_lines_header"]


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    training_data = {name for name in queries if name == "pipeline" or name.startswith("op")}
    assert set(queries) - set(sql) - training_data == {"sequence_scores", "sequence_regression", "sequence_common_window"}


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, con.sql(entry.oracle_sql()[name]).df()).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).columns

"""Sinks and sources: tables written to the scratch folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelmill.catalog.common import PREDICTIONS, SERIES_SQL, evaluation, inputs, metrics_sql, query, rounded, sql_round
from panelmill.catalog.models import METRICS
from panelmill.catalog.panels import MARKED, SUMMARY_SQL
from panelmill.functions.numbers import locale_number
from panelmill.operators import metrics
from panelmill.plans import panel
from panelmill.session import scratch_dir
from panelmill.sources import driver_tables as dt
from panelmill.sources import files, store


def _place(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_predictions(spark, sf):
    """Predictions kept by product, model and feature set; metrics of the full ones from there."""
    path = _place(spark, "predictions")
    store.write_results(evaluation(spark, sf).predictions, path)
    kept = store.read_results(spark, path, feature_set="full")
    return rounded(metrics.regression_metrics(kept, metrics.SERIES))


def metadata_documents(spark, sf):
    """Metadata documents written as JSON, and their summary read back."""
    path = _place(spark, "metadata")
    store.save_json(panel.dataset_metadata(inputs(spark, sf).wide()), path)
    return store.metadata_rollup(spark, path).drop("product_name")


def csv_scan(spark, sf):
    """Customers written as CSV text and read back with every column as text."""
    path = _place(spark, "customers")
    store.save_csv(dt.table(spark, sf, "customer"), path)
    text = files.read_csv_with_fallback(spark, path)
    return text.select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment",
        locale_number(F.col("c_acctbal")).alias("c_acctbal"),
    )


FILES = 64
FILE_HEADER = "c_custkey,c_name,c_mktsegment"


def csv_after_preamble(spark, sf):
    """Order totals written as text files with a preamble line in front of each header."""
    path = _place(spark, "orders")
    number = F.pmod(F.xxhash64("o_orderkey"), F.lit(FILES)).cast("int")
    rows = dt.table(spark, sf, "orders").select(
        F.concat_ws(",", F.year("o_orderdate"), F.lit("Enero"), F.col("o_totalprice"), F.lit("")).alias("line"),
        number.alias("number"), F.lit(2).alias("place"),
    )
    start = F.array(*[F.struct(F.lit(v).alias("line"), F.lit(i).alias("place")) for i, v in enumerate(("Fuente: pedidos,,,", "Año,Mes,IBC,"))])
    heads = rows.select("number").distinct().select("number", F.inline(start))
    whole = rows.unionByName(heads).repartition("number").sortWithinPartitions("number", "place")
    whole.select("number", "line").write.partitionBy("number").text(path)
    series = files.load_sector_index(spark, path, "ibc", "ano,mes,ibc")
    return rounded(series.groupBy("fecha").agg(F.count(F.lit(1)).alias("orders"), F.sum("ibc").alias("total")), 2)


def written_files_header(spark, sf):
    """Customers written as text files with up to four title lines; header and profile of each file read back."""
    path = _place(spark, "titled")
    rows = dt.table(spark, sf, "customer").select(
        (F.col("c_custkey") % FILES).alias("number"), F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment").alias("line"),
        F.lit(9).alias("place"),
    )
    titles = (F.col("number") % 5).cast("int")
    heads = rows.select("number").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), titles)))
    heads = heads.withColumn("line", F.when(F.col("place") == titles, F.lit(FILE_HEADER)).otherwise(F.lit("title")))
    whole = rows.unionByName(heads).repartition("number").sortWithinPartitions("number", "place")
    whole.select("number", "line").write.partitionBy("number").text(path)
    lines = files.file_lines(spark, path)
    headers = files.header_by_width(lines)
    return headers.join(files.file_profile(lines, headers), "file", "left").select(
        F.regexp_extract("file", "/number=([0-9]+)/", 1).cast("long").alias("number"),
        F.col("header_line").cast("long").alias("header_line"), "header",
        F.coalesce("filas", F.lit(0)).alias("filas"), F.coalesce("columnas", F.lit(0)).cast("long").alias("columnas"),
    )


QUERIES = {f.__name__: f for f in (stored_predictions, metadata_documents, csv_scan, csv_after_preamble, written_files_header)}

ORACLES = {
    "stored_predictions": query(
        f"{PREDICTIONS}, m AS ({metrics_sql('predictions', SERIES_SQL)})",
        f"SELECT {SERIES_SQL}, {sql_round(METRICS)}, n_test FROM m WHERE feature_set = 'full'",
    ),
    "metadata_documents": query(MARKED, SUMMARY_SQL),
    "csv_scan": "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer",
    "csv_after_preamble": f"""SELECT make_date(year(o_orderdate), 1, 1) AS fecha, count(*) AS orders,
       {sql_round(['total'], 2).replace('total', 'sum(o_totalprice)', 1)} FROM orders GROUP BY 1""",
    "written_files_header": f"""SELECT c_custkey % {FILES} AS number, c_custkey % {FILES} % 5 AS header_line,
       '{FILE_HEADER}' AS header, count(*) AS filas, 3 AS columnas FROM customer GROUP BY 1, 2""",
}

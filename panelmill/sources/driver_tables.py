"""Stand-ins for the price sources, derived from order and line-item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _month(column: str):
    return F.trunc(F.col(column).cast("date"), "month")


def market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market quotes: the buyer's nation is the province."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", _month("l_shipdate").alias("fecha")
    )
    buyers = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderpriority")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderpriority", "c_mktsegment", "n_name")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("p_brand").alias("producto"),
            F.col("n_name").alias("provincia"),
            F.col("c_mktsegment").alias("mercado"),
            F.col("o_orderpriority").alias("tipo_mercado"),
            "fecha",
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("precio_promedio_usdkg"),
            F.col("l_extendedprice").alias("promedio_de_precio_usd"),
        )
    )


def _sales(spark: SparkSession, sf_dir: str, line_columns: list[str], part_columns: list[str]) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", _month("l_shipdate").alias("fecha"), *line_columns
    )
    sellers = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("provincia"))
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", *part_columns)
    return lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )


def producer_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farm-gate quotes: the seller's nation is the province."""
    sales = _sales(spark, sf_dir, ["l_extendedprice", "l_discount", "l_quantity"], ["p_brand"])
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
    return sales.select(F.col("p_brand").alias("producto"), "provincia", "fecha", price.alias("precio_promedio_usdkg"))


def input_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input quotes: the part type is the kind of input."""
    sales = _sales(spark, sf_dir, ["l_extendedprice"], ["p_type", "p_name"])
    return sales.select(
        F.col("p_type").alias("tipo_insumo"), F.col("p_name").alias("ingrediente_activo"), "provincia", "fecha",
        F.col("l_extendedprice").alias("promedio_de_precio"),
    )


INPUT_CATEGORY = "economy"


def macro_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The monthly price index and three sector indices as separate national series."""
    monthly = (
        table(spark, sf_dir, "orders")
        .select(_month("o_orderdate").alias("fecha"), "o_totalprice", "o_orderstatus")
        .groupBy("fecha")
        .agg(
            F.avg("o_totalprice").alias("ipc_alimentos"),
            F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("ibc"),
            F.max("o_totalprice").alias("ipm"),
            F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("ipp_n"),
        )
    )
    months = Window.orderBy("fecha")  # one row per month
    year = Window.partitionBy(F.year("fecha")).orderBy("fecha")

    def growth(base):
        return 100 * (F.col("ipc_alimentos") / base - 1)

    ipc = monthly.select(
        "fecha",
        "ipc_alimentos",
        growth(F.lag("ipc_alimentos", 1).over(months)).alias("inflacion_mensual"),
        growth(F.lag("ipc_alimentos", 12).over(months)).alias("inflacion_anual"),
        growth(F.first("ipc_alimentos").over(year)).alias("inflacion_acumulada"),
    )
    indices = {name: monthly.select("fecha", name).where(F.col(name).isNotNull()) for name in ("ibc", "ipm", "ipp_n")}
    return {"ipc": ipc, **indices}

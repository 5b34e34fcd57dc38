"""Scratch space and materialisation shared by the plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Where nothing is configured, a session with a local master gets a temporary folder. On a cluster
    that is an error, because executors could not see each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelmill-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to a table in the scratch folder and read it back.

    Cuts the lineage, survives lost executors, and lets several jobs share one computation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._staged_path = path
    return stored


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that `materialise` wrote and that no frame reads any more.

    Also lets Spark drop the shuffle files of finished jobs, which it does only when the driver
    collects its garbage.
    """
    jvm = spark.sparkContext._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table._staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partitions by `keys`, two tasks per core, for work that costs far more than its bytes.

    Adaptive execution merges small partitions by size, which would put refits, replicas or
    forecast steps of all entities in one task; a requested count is left alone. The count
    differs from the session's own, or the planner would drop the step where rows already are
    grouped by these keys. Groupings and windows by the same keys need no further shuffle.
    """
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(2 * max(configured, spark.sparkContext.defaultParallelism), *keys)

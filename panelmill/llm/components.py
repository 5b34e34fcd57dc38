"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.session import materialise, release


def _settled(star: DataFrame) -> bool:
    """Whether every node of `star` (src, dst; src larger) has one smaller neighbour at most, and that one has none."""
    ends = star.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(star.select("dst", F.lit(0), F.lit(1))).groupBy("node")
    return ends.agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of `links` (a, b); the component is its smallest node. The result is stored.

    Alternates the two star steps: every node's larger neighbours, then its smaller ones, are linked
    to the smallest neighbour, until each node is linked with its component alone. Each step is a grouped
    minimum, combined on the map side, and a join that adaptive execution splits where a node has many links.
    Steps are written to the shared folder, so that plans stay small; only whether one is left to do reaches the driver.
    """
    spark = links.sparkSession
    star = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(), name
    )
    while not _settled(star):
        both = star.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(star.select("dst", "src"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()
        large = materialise(large, name)
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        last, star = star, materialise(small.union(least).distinct(), name)
        release(spark, last, large)
    roots = star.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node"))
    found = materialise(star.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots), name)
    release(spark, star)
    return found

"""Ranks and running sums within groups, of which one may hold most of the rows.

Rows of a group are dealt over buckets by a hash of their order. Bucket totals give every bucket its
first rank, and only buckets are sorted, so no task gets a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, groups: list[str], order: list[str], amount: Column, out: str, seed: str = "") -> DataFrame:
    """`df` with `out`: the sum of `amount` over the rows of the group before this one.

    The order is pseudo-random: by a hash of `seed` and `order`, ties by `order`. Rows that agree in
    all of `order` are interchangeable. Groups compare as in GROUP BY: nulls are one group.
    """
    key = F.xxhash64(F.lit(seed), *order)
    df = df.withColumns({"_key": key, "_amount": amount}).withColumn("_bucket", F.pmod("_key", F.lit(buckets(df))))
    named = {f"_g{i}": F.col(g) for i, g in enumerate(groups)}
    totals = df.select(*[c.alias(n) for n, c in named.items()], F.col("_bucket").alias("_b"), "_amount")
    totals = totals.groupBy(*named, "_b").agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*named).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    same = F.col("_bucket") == F.col("_b")
    for n, c in named.items():
        same = same & c.eqNullSafe(F.col(n))
    within = Window.partitionBy(*groups, "_bucket").orderBy("_key", *order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(totals, same)
    value = F.col("_base") + F.coalesce(F.sum("_amount").over(within), F.lit(0))
    return joined.withColumn(out, value).drop("_key", "_amount", "_bucket", "_b", "_base", *named)


def ranked(df: DataFrame, groups: list[str], order: list[str], out: str, seed: str = "") -> DataFrame:
    """`df` with `out`: the row's pseudo-random place in its group, from 0."""
    return running(df, groups, order, F.lit(1).cast("long"), out, seed)

"""Grouped aggregates that keep working when one group holds most of the rows.

Every operator first reduces rows on the map side, so that what is shuffled is bounded by the
number of distinct values and not by the number of rows, and no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def partial_cells(df: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Row count, sum and non-null count of each measure per distinct combination of `by`.

    Raw text can be cleaned after this step, once per distinct spelling instead of per row.
    """
    sums = [F.sum(m).alias(f"{m}__sum") for m in measures]
    counts = [F.count(m).alias(f"{m}__n") for m in measures]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows__n"), *sums, *counts)


def cell_mean(measure: str) -> Column:
    """Mean over cells, null when no value was present."""
    n = F.sum(f"{measure}__n")
    return F.when(n > 0, F.sum(f"{measure}__sum") / n)


def profile_cells(
    cells: DataFrame,
    keys: list[str],
    means: dict[str, str],
    count: str,
    modes: dict[str, str] | None = None,
    distincts: dict[str, str] | None = None,
) -> DataFrame:
    """Means, row count, most common non-blank values and distinct counts per key.

    `means`, `modes` and `distincts` map an output name to a cell column. Modes break ties
    towards the smallest value and give "" when all values are blank. Each described column is
    counted per value before the final aggregate, so its buffers stay of fixed size.
    """
    modes, distincts = modes or {}, distincts or {}
    described = list(dict.fromkeys([*modes.values(), *distincts.values()]))
    carried = sorted({f"{m}__{part}" for m in means.values() for part in ("sum", "n")} | {"rows__n"})
    if not described:
        return cells.groupBy(*keys).agg(
            *[cell_mean(m).alias(out) for out, m in means.items()], F.sum("rows__n").alias(count)
        )

    kinds = F.explode(
        F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in described])
    )
    long = cells.select(*keys, *carried, kinds.alias("d")).select(*keys, *carried, "d.kind", "d.value")
    by_value = long.groupBy(*keys, "kind", "value").agg(*[F.sum(c).alias(c) for c in carried])

    first = F.col("kind") == described[0]
    def total(name: str) -> Column:
        return F.sum(F.when(first, F.col(name)))

    outputs = [
        F.when(total(f"{m}__n") > 0, total(f"{m}__sum") / total(f"{m}__n")).alias(out)
        for out, m in means.items()
    ]
    outputs.append(total("rows__n").alias(count))
    for out, source in modes.items():
        candidate = (F.col("kind") == source) & (F.trim(F.coalesce("value", F.lit(""))) != "")
        best = F.min(F.when(candidate, F.struct((-F.col("rows__n")).alias("n"), F.col("value").alias("v"))))
        outputs.append(F.coalesce(best["v"], F.lit("")).alias(out))
    for out, source in distincts.items():
        outputs.append(F.count_if((F.col("kind") == source) & F.col("value").isNotNull()).alias(out))
    return by_value.groupBy(*keys).agg(*outputs)


def most_common(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """Most common non-blank value per key, ties to the smallest, "" when there is none."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    usable = F.trim(F.coalesce(value, F.lit(""))) != ""
    best = F.min(F.when(usable, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))))
    return counted.groupBy(*keys).agg(F.coalesce(best["v"], F.lit("")).alias(alias))


def with_bucket(df: DataFrame, order: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds `bucket__`, a split of the ordering column into ranges of similar size.

    The range edges come from one mergeable sketch over all rows. They only spread the work:
    results built on the buckets are exact whatever the edges are.
    """
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = df.agg(F.percentile_approx(order, shares, F.lit(1000)).alias("edges")).scalar()
    # A binary search, one small projection per step: a single expression over all edges is more code than the JVM
    # compiles, and a lambda over the ordering column fails where the frame is joined with its own totals, since the
    # optimiser copies it to the side that lacks the column.
    placed = df.withColumns({"edges__": edges, "bucket__": F.lit(0)})
    for bit in reversed(range((buckets - 1).bit_length())):
        above = F.try_element_at("edges__", F.col("bucket__") + F.lit(1 << bit)) < F.col(order)
        placed = placed.withColumn("bucket__", F.col("bucket__") + F.when(above, F.lit(1 << bit)).otherwise(F.lit(0)))
    return placed.drop("edges__")


def bucket_totals(bucketed: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Per key and bucket: what all earlier buckets add up to, and the bucket's own sums."""
    totals = bucketed.groupBy(*keys, "bucket__").agg(*[F.sum(c).alias(f"{c}__own") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns(
        {f"{c}__before": F.coalesce(F.sum(f"{c}__own").over(earlier), F.lit(0)) for c in sums}
    )


def running_totals(df: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """Adds `<c>__upto`, the sum of `c` over all rows of the key up to and including this one.

    A two-level prefix sum: within a range bucket by a window, across buckets by their totals,
    so a key with most of the rows is still spread over many tasks. `order` must be unique
    within a key and numeric.
    """
    bucketed = with_bucket(df, order)
    before = bucket_totals(bucketed, keys, sums)
    here = Window.partitionBy(*keys, "bucket__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = bucketed.join(before, [*keys, "bucket__"])
    upto = {f"{c}__upto": F.col(f"{c}__before") + F.sum(c).over(here) for c in sums}
    return joined.withColumns(upto).drop(
        "bucket__", *[f"{c}__{part}" for c in sums for part in ("own", "before")]
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, shares: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact quantiles per key with linear interpolation; `shares` maps output name to share.

    Rows are counted per distinct value, spread over range buckets, and only the buckets that
    hold a wanted rank are sorted. Nulls are ignored.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
    bucketed = with_bucket(counted, value)
    whole = Window.partitionBy(*keys)
    ranks = bucket_totals(bucketed, keys, ["n"]).withColumn("size", F.sum("n__own").over(whole))

    def wanted(share: float) -> tuple[Column, Column]:
        place = F.lit(share) * (F.col("size") - 1)
        return F.floor(place), F.ceil(place)

    hits = [
        (F.col("n__before") <= r) & (r < F.col("n__before") + F.col("n__own"))
        for share in shares.values()
        for r in wanted(share)
    ]
    needed = hits[0]
    for hit in hits[1:]:
        needed = needed | hit
    chosen = bucketed.join(ranks.where(needed), [*keys, "bucket__"])
    here = Window.partitionBy(*keys, "bucket__").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = chosen.withColumn("upto", F.col("n__before") + F.sum("n").over(here))

    outputs = []
    for name, share in shares.items():
        low, high = wanted(share)
        def at(rank: Column) -> Column:
            inside = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
            return F.max(F.when(inside, F.col(value)))
        part = F.max(F.lit(share) * (F.col("size") - 1) - low)
        outputs.append((at(low) + (at(high) - at(low)) * part).alias(name))
    if not keys:
        return placed.agg(*outputs)
    return placed.groupBy(*keys).agg(*outputs)

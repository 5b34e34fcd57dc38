"""Temporal splits: holdout cutoffs, positional splits, expanding folds and the month spine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.constants import HOLDOUT_RATIO, MIN_WINDOW_MONTHS, VALIDATION_WINDOWS
from panelmill.operators.windows import ENTITY, forward_fill

PRODUCT = ["product_key"]


def split_index(rows: Column, train_ratio: float, clamp: bool = True) -> Column:
    """Number of leading rows that train; clamped so that both parts keep at least one row."""
    index = F.floor(rows * F.lit(train_ratio))
    return F.greatest(F.lit(1), F.least(index, rows - 1)) if clamp else index


def positional_split(
    df: DataFrame,
    keys: list[str] | None = None,
    train_ratio: float = 1 - HOLDOUT_RATIO,
    date: str = "fecha",
    labels: tuple[str, str] = ("train", "test"),
    alias: str = "split",
) -> DataFrame:
    """Labels the first share of each entity's rows by position."""
    keys = ENTITY if keys is None else keys
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(date))
    rows = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn(
        alias, F.when(place <= split_index(rows, train_ratio), labels[0]).otherwise(labels[1])
    )


def nested_split(df: DataFrame, keys: list[str] | None = None, ratio: float = 1 - HOLDOUT_RATIO) -> DataFrame:
    """Positional train/test split with the train part split again into fit and validation."""
    outer = positional_split(df, keys, ratio)
    train = positional_split(outer.where("split = 'train'"), keys, ratio, labels=("fit", "validation"), alias="part")
    return train.unionByName(outer.where("split = 'test'").withColumn("part", F.lit("test")))


def series_split(df: DataFrame, ratio: float = 1 - HOLDOUT_RATIO, date: str = "fecha") -> DataFrame:
    """Unclamped split of one national series: its only partition holds one row per month."""
    place = F.row_number().over(Window.partitionBy().orderBy(date))
    rows = F.count(F.lit(1)).over(Window.partitionBy())
    return df.withColumn("split", F.when(place <= split_index(rows, ratio, clamp=False), "train").otherwise("test"))


def holdout_cutoffs(
    df: DataFrame, keys: list[str] | None = None, test_ratio: float = HOLDOUT_RATIO, date: str = "fecha"
) -> DataFrame:
    """First test date of each entity."""
    keys = ENTITY if keys is None else keys
    placed = df.select(
        *keys,
        date,
        F.row_number().over(Window.partitionBy(*keys).orderBy(date)).alias("place"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("rows"),
    )
    at_cutoff = F.col("place") == split_index(F.col("rows"), 1 - test_ratio) + 1
    return placed.groupBy(*keys).agg(F.max(F.when(at_cutoff, F.col(date))).alias("cutoff"))


def apply_cutoffs(df: DataFrame, cutoffs: DataFrame, keys: list[str] | None = None, date: str = "fecha") -> DataFrame:
    """Adds `split`; entities without a cutoff are left out."""
    keys = ENTITY if keys is None else keys
    joined = df.join(cutoffs.where(F.col("cutoff").isNotNull()), keys)
    return joined.withColumn("split", F.when(F.col(date) < F.col("cutoff"), "train").otherwise("test"))


def holdout(df: DataFrame, keys: list[str] | None = None, test_ratio: float = HOLDOUT_RATIO) -> DataFrame:
    """Cutoff and split in one pass over the entity windows, without joining back."""
    keys = ENTITY if keys is None else keys
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("fecha"))
    rows = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at_cutoff = F.col("place__") == split_index(F.col("rows__"), 1 - test_ratio) + 1
    cutoff = F.max(F.when(at_cutoff, F.col("fecha"))).over(Window.partitionBy(*keys))
    return (
        df.withColumns({"place__": place, "rows__": rows})
        .withColumn("cutoff", cutoff)
        .where(F.col("cutoff").isNotNull())
        .withColumn("split", F.when(F.col("fecha") < F.col("cutoff"), "train").otherwise("test"))
        .drop("place__", "rows__")
    )


def split_violations(df: DataFrame, keys: list[str] | None = None, date: str = "fecha") -> DataFrame:
    """Entities whose test part does not start after their train part ends."""
    keys = ENTITY if keys is None else keys
    ends = df.groupBy(*keys).agg(
        F.max(F.when(F.col("split") == "train", F.col(date))).alias("last_train"),
        F.min(F.when(F.col("split") == "test", F.col(date))).alias("first_test"),
    )
    return ends.where(F.col("first_test") <= F.col("last_train"))


def check_split(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    bad = split_violations(df, keys).head(1)
    if bad:
        raise ValueError(f"test starts before train ends: {bad[0].asDict()}")
    return df


def date_chunks(
    train: DataFrame,
    group: list[str] | None = None,
    windows: int = VALIDATION_WINDOWS,
    min_months: int = MIN_WINDOW_MONTHS,
    date: str = "fecha",
) -> DataFrame:
    """Chunk number of every distinct date; three validation chunks, or two when they are short.

    The partitions hold distinct dates only.
    """
    group = PRODUCT if group is None else group
    dates = train.select(*group, date).distinct()
    total = F.count(F.lit(1)).over(Window.partitionBy(*group))
    order = Window.partitionBy(*group).orderBy(date)
    chunk = F.lit(None).cast("int")
    used = F.lit(None).cast("int")
    for w in range(2, windows + 1):  # the largest count that is long enough wins
        enough = F.lit(True) if w == 2 else F.floor(total / (w + 1)) >= min_months
        chunk = F.when(enough, F.ntile(w + 1).over(order)).otherwise(chunk)
        used = F.when(enough, F.lit(w)).otherwise(used)
    return dates.withColumns({"chunk": chunk, "windows": used})


def fold_bounds(train: DataFrame, group: list[str] | None = None, **options) -> DataFrame:
    """One row per expanding fold: end of its training dates, start and end of its validation."""
    group = PRODUCT if group is None else group
    chunks = date_chunks(train, group, **options)
    spans = chunks.groupBy(*group, "windows", "chunk").agg(
        F.min("fecha").alias("val_start"), F.max("fecha").alias("val_end")
    )
    previous = Window.partitionBy(*group).orderBy("chunk")
    return (
        spans.withColumn("train_end", F.lag("val_end").over(previous))
        .where(F.col("chunk") > 1)
        .select(*group, (F.col("chunk") - 1).alias("fold"), "windows", "train_end", "val_start", "val_end")
    )


def assign_folds(df: DataFrame, bounds: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Validation rows with the fold they belong to; each row falls in at most one fold."""
    group = PRODUCT if group is None else group
    folds = bounds.groupBy(*group).agg(
        F.collect_list(F.struct("fold", "windows", "train_end", "val_start", "val_end")).alias("folds")
    )
    inside = F.filter("folds", lambda f: F.col("fecha").between(f["val_start"], f["val_end"]))
    return (
        df.join(folds, group)
        .withColumn("f", F.try_element_at(inside, F.lit(1)))
        .where("f is not null")
        .select(*df.columns, "f.fold", "f.windows", "f.train_end")
    )


def entity_folds(bounds: DataFrame, cutoffs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per entity, the folds that end before its holdout begins."""
    group = PRODUCT if group is None else group
    return cutoffs.join(bounds, group).where(F.col("val_end") < F.col("cutoff"))


def last_fold(bounds: DataFrame) -> DataFrame:
    return bounds.where(F.col("fold") == F.col("windows"))


def month_spine(df: DataFrame, values: list[str], keys: list[str] | None = None, fill: bool = True) -> DataFrame:
    """Regular monthly series per entity; gaps are forward-filled unless `fill` is off.

    Each row spans the months up to the entity's next row, so no join back is needed.
    """
    keys = ENTITY if keys is None else keys
    spec = Window.partitionBy(*keys).orderBy("fecha")
    following = F.lead("fecha").over(spec)
    last_month = F.coalesce(F.add_months(following, -1), F.col("fecha"))
    carried = {v: forward_fill(F.col(v), spec) if fill else F.col(v) for v in values}
    spans = df.select(*keys, "fecha", *values).withColumns({"until": last_month, **carried})
    months = F.posexplode(F.sequence("fecha", "until", F.expr("interval 1 month"))).alias("step", "month")
    wide = spans.select(*keys, *values, months)
    observed = F.col("step") == 0
    kept = [F.col(v) if fill else F.when(observed, F.col(v)).alias(v) for v in values]
    return wide.select(*keys, F.col("month").alias("fecha"), observed.alias("observed"), *kept)

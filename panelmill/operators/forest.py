"""Boosted regression trees for any number of groups at once, as grouped aggregates over whole numbers.

All models (products, feature sets, folds) grow together: a level of a tree is one histogram over
(model, node, feature, bin), one choice of the best split per node and one join of the chosen splits. Features
and target are whole steps of a fixed grid, so sums are exact and the result depends neither on the
partitioning nor on retries. A fitted model is a table of nodes, `NODES`, and is scored by expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import materialise, release

#: Steps of the grid per unit. Its edges lie off the values that means of a few prices can take.
GRID, OFF_EDGE = 10_000, 0.3819660112501051
#: Columns of a node table besides the keys of its models. Tree 0 is the start value. An inner node sends a row
#: right where its feature reaches `threshold`; its children are nodes 2n+1 and 2n+2. `value` belongs to leaves.
NODES = ["tree", "node", "feature", "threshold", "gain", "value", "rows"]


@dataclass(frozen=True)
class TreeParams:
    rounds: int = 12
    depth: int = 2
    step: float = 0.3
    penalty: float = 1.0
    min_rows: int = 5
    bins: int = 32


def on_grid(value: Column) -> Column:
    """A number as whole steps of the grid."""
    return F.floor(value.cast("double") * F.lit(float(GRID)) + F.lit(OFF_EDGE))


def off_grid(steps: Column) -> Column:
    return steps / F.lit(float(GRID))


def _ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edges): the first value and the width of each feature's range, in the order of `x`."""
    each = rows.select(*keys, F.posexplode("x").alias("feature", "v"))
    ranges = each.groupBy(*keys, "feature").agg(F.min("v").alias("low"), (F.max("v") - F.min("v") + 1).alias("width"))
    return ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("feature", "low", "width"))).alias("edges"))


def _binned(rows: DataFrame, ranges: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """`rows` with x as bins of equal width over each model's own ranges."""
    place = F.zip_with("x", "edges", lambda v, e: F.floor((v - e["low"]) * bins / e["width"]).cast("int"))
    return rows.join(ranges, keys).select(*keys, place.alias("bin"), "y")


def _splits(rows: DataFrame, keys: list[str], params: TreeParams) -> DataFrame:
    """Every node of `rows` with its split of most gain, if any helps: ties to the first feature, then the
    lowest bin. `value`, `left` and `right` are what the node and its children give as leaves."""
    node = [*keys, "node"]
    cells = rows.select(*node, "g", F.posexplode("bin").alias("feature", "b"))
    cells = cells.groupBy(*node, "feature", "b").agg(F.sum("g").alias("g"), F.count("*").alias("n"))
    feature = Window.partitionBy(*node, "feature")
    upto = feature.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select(
        *node, "feature", "b", F.sum("g").over(upto).alias("gl"), F.sum("n").over(upto).alias("nl"),
        F.sum("g").over(feature).alias("g"), F.sum("n").over(feature).alias("n"),
    )
    rest, others = F.col("g") - F.col("gl"), F.col("n") - F.col("nl")

    def score(total: Column, n: Column) -> Column:
        return total.cast("double") * total.cast("double") / (n.cast("double") + F.lit(params.penalty))

    gain = score(F.col("gl"), F.col("nl")) + score(rest, others) - score(F.col("g"), F.col("n"))
    usable = (F.col("nl") >= params.min_rows) & (others >= params.min_rows) & (gain > 0)
    best = F.min(F.when(usable, F.struct((-gain).alias("loss"), "feature", "b", "gl", "nl"))).alias("best")
    chosen = sums.groupBy(*node).agg(best, F.max("g").alias("g"), F.max("n").alias("rows"))

    def leaf(total: Column, n: Column) -> Column:
        return F.floor(F.lit(params.step) * (total.cast("double") / (n.cast("double") + F.lit(params.penalty))))

    gl, nl = F.col("best.gl"), F.col("best.nl")
    return chosen.select(
        *node, F.col("best.feature"), F.col("best.b").alias("split"), (-F.col("best.loss")).alias("gain"), "rows", nl.alias("left_rows"),
        leaf(F.col("g"), F.col("rows")).alias("value"), leaf(gl, nl).alias("left"), leaf(F.col("g") - gl, F.col("rows") - nl).alias("right"),
    )


def _sent(rows: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` moved to the children of the nodes that were split, `value` being that of the child or node."""
    chosen = splits.select(*keys, "node", F.col("feature").alias("f"), "split", "value", "left", "right")
    goes_right = F.element_at("bin", F.col("f") + 1) > F.col("split")
    node = F.when(F.col("f").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + goes_right.cast("int"))
    value = F.when(F.col("f").isNull(), F.col("value")).when(goes_right, F.col("right")).otherwise(F.col("left"))
    moved = rows.drop("value").join(chosen, [*keys, "node"])
    return moved.select(*keys, "bin", "g", node.alias("node"), value.alias("value"))


def fit_forests(rows: DataFrame, keys: list[str], params: TreeParams = TreeParams()) -> DataFrame:
    """Node tables (keys, NODES) of boosted trees of squared error, one model per value of `keys`.

    `rows` has the keys, `x` (features on the grid, in the same order everywhere within a model) and `y` (the
    target on the grid). A level of all models costs one pass over the rows; its splits and the residuals of
    each round are stored in the scratch folder, so a lost executor costs one level.
    """
    ranges = materialise(_ranges(rows, keys), "ranges")
    rows = materialise(_binned(rows, ranges, keys, params.bins), "binned")
    start = rows.groupBy(*keys).agg(F.floor(F.sum("y").cast("double") / F.count("*")).alias("value"), F.count("*").alias("rows"))
    start = materialise(start, "start")
    left = rows.join(start.select(*keys, "value"), keys).select(*keys, "bin", (F.col("y") - F.col("value")).alias("g"))
    parts, stored = [start.select(*keys, F.lit(0).alias("tree"), F.lit(0).alias("node"), *_blank("feature", "split", "gain"), "value", "rows")], [start]
    residuals = rows
    for tree in range(1, params.rounds + 1):
        placed = left.withColumn("node", F.lit(0))
        for level in range(1, params.depth + 1):
            splits = materialise(_splits(placed, keys, params), "splits")
            stored.append(splits)
            parts.extend(_nodes(splits, tree, keys, level == params.depth))
            placed = _sent(placed, splits, keys)
        if tree < params.rounds:
            last, residuals = residuals, materialise(placed.select(*keys, "bin", (F.col("g") - F.col("value")).alias("g")), "residuals")
            release(rows.sparkSession, last)
            left = residuals
    nodes = reduce(DataFrame.unionByName, parts).join(ranges.select(*keys, F.inline("edges")), [*keys, "feature"], "left")
    threshold = F.col("low") + F.ceil((F.col("split") + 1) * F.col("width") / params.bins)
    nodes = materialise(nodes.withColumn("threshold", threshold).select(*keys, *NODES), "nodes")
    release(rows.sparkSession, ranges, residuals, *stored)
    return nodes


def _blank(*names: str) -> list[Column]:
    kinds = {"feature": "int", "split": "int", "gain": "double", "value": "long"}
    return [F.lit(None).cast(kinds[n]).alias(n) for n in names]


def _nodes(splits: DataFrame, tree: int, keys: list[str], last: bool) -> list[DataFrame]:
    """Rows of a node table (with the bin that `threshold` follows from) for a level; after the last one, leaves."""
    def leaf(node: Column, value: str, rows: Column) -> list[Column]:
        return [node.alias("node"), *_blank("feature", "split", "gain"), F.col(value).alias("value"), rows.alias("rows")]

    model = [*keys, F.lit(tree).alias("tree")]
    split = splits.where("feature is not null")
    parts = [split.select(*model, "node", "feature", "split", "gain", *_blank("value"), "rows")]
    if last:
        parts.append(split.select(*model, *leaf(2 * F.col("node") + 1, "left", F.col("left_rows"))))
        parts.append(split.select(*model, *leaf(2 * F.col("node") + 2, "right", F.col("rows") - F.col("left_rows"))))
        parts.append(splits.where("feature is null").select(*model, *leaf(F.col("node"), "value", F.col("rows"))))
    return parts


def packed(nodes: DataFrame, keys: list[str], name: str = "forest") -> DataFrame:
    """One row per model: (keys, `name`), an array of trees, each with its arrays in the order of its nodes.

    A row is as large as its model, so one join brings every row of a model its trees.
    """
    size = F.col("node") + 1
    trees = nodes.groupBy(*keys, "tree").agg(
        F.max(size).alias("size"), F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "threshold", "value")))).alias("at")
    )
    heap = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda n: F.try_element_at("at", n))
    trees = trees.select(*keys, F.struct("tree", heap.alias("heap")).alias("t"))
    return trees.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias(name))


def _leaf(heap: Column, x: Column, depth: int) -> Column:
    """Place of the leaf that `x` reaches: a step down per level, standing still in a leaf."""
    def down(node: Column, _: Column) -> Column:
        at = F.element_at(heap, node + 1)
        right = (F.element_at(x, at["feature"] + 1) >= at["threshold"]).cast("int")
        return F.when(at["threshold"].isNull(), node).otherwise(2 * node + 1 + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down)


def tree_values(forest: Column, x: Column, depth: int) -> Column:
    """Value of each tree for the features `x` (on the grid), the start value first."""
    return F.transform(forest, lambda t: F.element_at(t["heap"], _leaf(t["heap"], x, depth) + 1)["value"])


def forest_prediction(forest: Column, x: Column, depth: int) -> Column:
    """Prediction of a packed forest, off the grid."""
    return off_grid(F.aggregate(tree_values(forest, x, depth), F.lit(0).cast("long"), lambda a, v: a + v))


def gain_shares(nodes: DataFrame, keys: list[str], features: Column) -> DataFrame:
    """(keys, position, feature, gain, importance) from a node table: gain summed per feature, and its share of
    the model's. `features` is the array of names of a model; those without a split have none."""
    used = nodes.where("feature is not null").groupBy(*keys, F.col("feature").alias("position")).agg(F.sum("gain").alias("gain"))
    named = nodes.where("tree = 0").select(*keys, F.posexplode(features).alias("position", "feature"))
    both = named.join(used, [*keys, "position"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    total = F.sum("gain").over(Window.partitionBy(*keys))
    return both.withColumn("importance", F.when(total > 0, F.col("gain") / total).otherwise(F.lit(0.0)))

"""Mixing of sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.ranks import ranked, running
from panelmill.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
#: Words of a block, and output shards; shards are halved again and again, so a power of two.
BLOCK_WORDS = 4096
SHARDS = 8
#: Sources whose counts one row of a node holds while it is split.
TOGETHER = 256
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """`sizes` (source, source_size) with the place, weight and target of each source.

    Sources by code point, null last, weigh WEIGHTS in turn and share SHARE times all words; a target
    stops at LIMIT times its source's size, and the rest is shared by weight again. That is the least
    of the limit and a common level times the weight. The level follows from one pass over the sources
    by limit per weight: the first that stays below its limit sets it. One row per source is ordered.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sizes.withColumn("place", place)
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    rows = rows.withColumns({
        "weight": F.element_at(weights, ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")),
        "limit": LIMIT * F.col("source_size"),
        "words": SHARE * F.sum("source_size").over(everything),
    })
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    full = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("words") - full) / weight)
    first = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "place", "level"))
    level = F.min(first).over(everything)["level"]
    return rows.withColumn("target", F.least(F.col("limit").cast("double"), level * F.col("weight"))).select(
        "source", "source_size", "place", "weight", "target"
    )


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str, block_words: int) -> DataFrame:
    """One row per id and source, with its words; their running sum in the source's permutation."""
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    units = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"))
    units = materialise(units.groupBy("id", "source").agg(F.sum("size").alias("size")), "units")
    units = running(units, ["source"], ["id"], F.col("size"), "start", "mix")
    return units.withColumn("block", F.floor(F.col("start") / block_words))


def _shared(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that compare as in GROUP BY."""
    other = table.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(other, same).drop(*[f"_{k}" for k in keys])


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` items are among the `marked` ones: the quantile `u` of that law.

    The weights of neighbouring counts differ by a simple factor, so the law is summed up from ten counts
    and twelve deviations below the mean to as many above; what lies beyond is less than a double can tell.
    """
    n, k, d = total.cast("double"), marked.cast("double"), drawn.cast("double")
    some = F.greatest(n, F.lit(1.0))
    mean = d * k / some
    reach = 12 * F.sqrt(mean * (some - k) / some * (n - d) / F.greatest(n - 1, F.lit(1.0))) + 10
    low, high = F.ceil(F.greatest(F.lit(0.0), d + k - n, mean - reach)), F.floor(F.least(k, d, mean + reach))
    counts = F.sequence(low, high)

    def after(w: Column, x: Column) -> Column:
        return w * (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

    whole = F.aggregate(
        counts, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
        lambda s, x: F.struct(after(s["w"], x).alias("w"), (s["sum"] + s["w"]).alias("sum")),
    )["sum"]
    return F.aggregate(
        counts, F.struct(F.lit(1.0).alias("w"), (u * whole).alias("rest"), F.lit(None).cast("long").alias("at")),
        lambda s, x: F.struct(
            after(s["w"], x).alias("w"), (s["rest"] - s["w"]).alias("rest"),
            F.coalesce(s["at"], F.when((s["rest"] < s["w"]) | (x == high), x)).alias("at"),
        ),
    )["at"]


def _split(rows: DataFrame, group: list[str], item: str, salt: str) -> DataFrame:
    """`rows` (group, item, count, half) with `left`: of `half` draws from all of a group, those of each item.

    Item after item draws its part of what is left, so the parts of a group add up to `half` and follow the
    multivariate hypergeometric law.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit(salt), *group, item), 11) / F.lit(2.0**53)
    entries = F.array_sort(F.collect_list(F.struct(item, "count", u.alias("u"))))
    groups = rows.groupBy(*group).agg(F.first("half").alias("half"), F.sum("count").alias("total"), entries.alias("entries"))

    def take(s: Column, e: Column) -> Column:
        found = _hypergeometric(s["total"], e["count"], s["half"], e["u"])
        return F.transform(F.array(found), lambda x: F.struct(
            (s["total"] - e["count"]).alias("total"), (s["half"] - x).alias("half"), F.concat(s["left"], F.array(x)).alias("left"),
        ))[0]

    start = F.struct("total", "half", F.array().cast("array<bigint>").alias("left"))
    groups = groups.withColumn("left", F.aggregate("entries", start, take)["left"])
    both = groups.select(*group, F.explode(F.arrays_zip("entries", "left")).alias("e"))
    return both.select(*group, f"e.entries.{item}", "e.entries.count", "e.left")


def _dealt(quotas: DataFrame, shards: int, seed: str = "mix") -> DataFrame:
    """`quotas` (place, draws) of the sources, split among the shards: place and `ends`, one per shard.

    Shard i gets a source's draws from ends[i - 1] to ends[i]. A node of the tree holds how many draws of
    each source lie below it, and half of all its draws go left. How many of those are of which source
    is drawn for TOGETHER sources at once first, then for each of them. Leaves differ by one draw at
    most. The table has a row per node and source, whatever the quotas.
    """
    rows = quotas.select(F.floor(F.col("place") / TOGETHER).alias("part"), "place", F.lit(0).alias("node"), F.col("draws").alias("count"))
    for level in range(shards.bit_length() - 1):
        node = Window.partitionBy("node")
        parts = rows.groupBy("node", "part").agg(F.sum("count").alias("count"))
        parts = parts.withColumn("half", F.floor((F.sum("count").over(node) + F.col("node") % 2) / 2))
        parts = _split(parts, ["node"], "part", f"{seed} parts {level}")
        rows = rows.join(parts.select("node", "part", F.col("left").alias("half")), ["node", "part"])
        rows = _split(rows, ["node", "part"], "place", f"{seed} sources {level}")
        sides = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("count")),
            F.struct((2 * F.col("node") + 1).alias("node"), (F.col("count") - F.col("left")).alias("count")),
        )
        rows = materialise(rows.select("part", "place", F.explode(sides).alias("side")).select("part", "place", "side.*"), "nodes")
    end = F.sum("count").over(Window.partitionBy("place").orderBy("node"))
    ends = F.array_sort(F.collect_list(F.struct("node", "end")))["end"]
    return rows.withColumn("end", end).groupBy("place").agg(ends.alias("ends"))


def _fill(units: DataFrame) -> DataFrame:
    """(id, source) of the documents that fill the room left after the last one that ends `within`.

    Of the documents that are left, the largest that fits is taken, again and again. Where one
    document more ends nearer the target than the best without, that one closes the source. Only
    counts per size below twice the room matter, so a source is one row of at most as many sizes.
    """
    rest = units.where("size > 0 and not within")
    line = units.groupBy("source").agg(
        F.first("over").alias("over"), F.max(F.when(F.col("within"), F.col("start") + F.col("size"))).alias("line")
    )
    line = materialise(line.select("source", (F.col("over") - F.coalesce("line", F.lit(0))).alias("room")), "room")
    near = _shared(rest.select("id", "source", "size"), line.where("room > 0"), ["source"]).where("size < 2 * room")
    near = materialise(near, "near")
    sizes = near.groupBy("source", "room", "size").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("source", "room").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    # error and closing: the least overshoot of one document more, and that document's size
    picked = F.expr("""aggregate(sizes,
        named_struct('room', room, 'takes', cast(array() as array<struct<size: bigint, take: bigint>>),
                     'error', room, 'closing', cast(null as bigint)),
        (s, x) -> transform(array(least(x.n, cast(floor(s.room / x.size) as bigint))), k -> named_struct(
            'room', s.room - k * x.size,
            'takes', if(k > 0, concat(s.takes, array(named_struct('size', x.size, 'take', k))), s.takes),
            'error', if(k < x.n and x.size - (s.room - k * x.size) < s.error, x.size - (s.room - k * x.size), s.error),
            'closing', if(k < x.n and x.size - (s.room - k * x.size) < s.error, x.size, s.closing)))[0])""")
    picked = sizes.select("source", picked.alias("p")).withColumn("closes", F.col("p.error") < F.col("p.room"))
    closed = F.expr("""concat(filter(p.takes, t -> t.size >= p.closing),
        array(named_struct('size', p.closing, 'take', cast(1 as bigint))))""")
    takes = picked.select("source", F.explode(F.when(F.col("closes"), closed).otherwise(F.col("p.takes"))).alias("t"))
    takes = materialise(takes.groupBy("source", "t.size").agg(F.sum("t.take").alias("take")), "takes")
    chosen = _shared(near.drop("room"), takes, ["source", "size"])
    return ranked(chosen, ["source", "size"], ["id"], "rank", "mix").where("rank < take").select("id", "source")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    shards: int = SHARDS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """How often each document is taken so that sources come near their targets, and by which shards.

    Returns a row per id and source: the id, source, size (words; null texts have none), source_size,
    target, copies, taken (copies times size) and shards (one per copy). Rows that repeat an id within
    a source are one document. Documents without words stay once, in no shard. `shards` is a power of two.

    A source's documents are permuted by a hash of their id and cut into blocks of `block_words` words.
    Its quota is a number of blocks: the permutation as often as the target holds the source, then the
    blocks that end within what is left, and one draw for the rest below a block: the documents after
    them that end within the target, and `_fill` for the room behind those. `_dealt` splits the quotas
    among the shards, and each shard draws that many blocks of the permutation, one shard after the
    other, so no draw is in two. Hashes decide, so reruns agree.
    """
    units = _units(docs, id_col, text_col, source_col, block_words)
    sources = targets(units.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("epochs", epochs).withColumn("over", F.col("target") - F.col("epochs") * F.col("source_size"))
    units = _shared(units, sources, ["source"])
    units = materialise(units.withColumn("within", F.col("start") + F.col("size") <= F.col("over")), "units")

    fill = materialise(_fill(units), "fill").select(F.col("id").alias("_i"), F.col("source").alias("_s"), F.lit(True).alias("filled"))
    rows = units.join(fill, F.col("id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_i", "_s")
    blocks = F.max("block") + 1
    quotas = units.where("size > 0").groupBy("place").agg(
        blocks.alias("blocks"), F.coalesce(F.min(F.when(~F.col("within"), F.col("block"))), blocks).alias("part"), F.first("epochs").alias("times"),
    )
    quotas = quotas.withColumn("rest", F.col("times") * F.col("blocks") + F.col("part"))
    quotas = materialise(quotas.withColumn("draws", F.col("rest") + 1), "quotas")
    quotas = quotas.join(_dealt(quotas, shards), "place").select("place", "blocks", "part", "rest", "ends")
    rows = rows.join(quotas, "place", "left")

    below = (F.col("within") & (F.col("block") >= F.col("part"))) | F.coalesce("filled", F.lit(False))
    draws = F.transform(F.sequence(F.lit(0).cast("long"), F.col("epochs")), lambda e: F.col("block") + e * F.col("blocks"))
    draws = F.concat(F.filter(draws, lambda d: d < F.col("rest")), F.when(below, F.array("rest")).otherwise(F.array().cast("array<bigint>")))
    taken = F.transform(draws, lambda d: F.size(F.filter("ends", lambda end: end <= d)))
    rows = rows.withColumn("shards", F.when(F.col("size") > 0, taken).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.size("shards")))
    return rows.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), "shards",
    )


def _free(name: str, taken: list[str]) -> str:
    """`name`, with as many underscores before it as make it differ from all of `taken`."""
    while name in taken:
        name = f"_{name}"
    return name


def mixed(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as `plan` takes it, with `shard` and `place`, the order within.

    Where `docs` has columns of these names, it keeps them and the new ones are called `_shard` and
    `_place`. Rows that repeat an id within a source are all taken as often as their document. Null
    ids and sources match each other. An empty table gives no rows.
    """
    wanted = plan.where("copies > 0").select(
        F.col(id_col).alias("of"), F.col(source_col).alias("from"),
        F.when(F.size("shards") > 0, F.col("shards")).otherwise(F.array(F.lit(None).cast("int"))).alias("shards"),
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col(f"row.{id_col}").eqNullSafe(F.col("of")) & F.col(f"row.{source_col}").eqNullSafe(F.col("from"))
    rows = rows.join(wanted, same).select("row", F.posexplode("shards").alias("copy", "shard"))
    shard, place = _free("shard", docs.columns), _free("place", docs.columns)
    order = F.xxhash64("shard", f"row.{id_col}", "copy").alias(place)
    return rows.select("row.*", F.col("shard").alias(shard), order)

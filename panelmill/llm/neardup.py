"""Near duplicates by bottom-k sketches from one hash function."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.components import components
from panelmill.llm.scan import Scanner, shingle_sets, slices
from panelmill.session import materialise, release

#: Retained values of a sketch, and how many of them two linked sets share at least. Of the K smallest
#: values of a union of which 80 % are common, fewer than SHARED are common in less than one of 10**5
#: pairs; at 85 % in less than one of 10**8.
K, SHARED = 64, 36
#: Sets up to this size are retained whole and compared exactly.
WHOLE = 192
#: Members of an inverted list with which all others are compared.
CENTRES = 5
#: Lists in which a pair with a centre has to meet before its sketches are compared.
MET = 2
#: Common values of two sketches from which on they are taken as linked until confirmed.
LIKELY = 52
#: Retained values in which a pair has to agree before its sketches are compared.
AGREE = 2
#: Bytes of text whose sets a task holds at once.
SLICE = 1 << 18


def _sets(sketch: int | None):
    """Arrow function: id and text to id, set size, set digest and its `sketch` smallest hashes (None: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(seed=9, lower=True)
        for part in (part for batch in batches for part in slices(batch, 1, SLICE)):
            _, sets = shingle_sets(scanner, part.column(1))
            kept = [s if sketch is None or len(s) <= WHOLE and sketch else s[:sketch] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
            values = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            ], names=["id", "n", "set_id", "hashes"])

    return run


def _schema(kind: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()),
        T.StructField("hashes", T.ArrayType(T.LongType())),
    ])


def _entries(classes: DataFrame) -> DataFrame:
    """(node, form, value): the values of each sketch, hashed with their kind; `form` is the set's size twice, plus the kind.

    A shuffled row has the size and the kind in one number; the rest follows from them.
    """
    n = F.col("n")
    whole = F.struct(F.lit(0).alias("kind"), F.col("sketch").alias("values"))
    small = F.struct(F.lit(1).alias("kind"), F.slice("sketch", 1, K).alias("values"))
    kinds = F.when(n <= int(0.8 * WHOLE), F.array(whole)).when(n <= WHOLE, F.array(whole, small)).otherwise(F.array(small))
    entries = classes.select("node", "n", F.explode(kinds).alias("k")).select(
        "node", (2 * F.col("n") + F.col("k.kind")).alias("form"), "k.kind", F.explode("k.values").alias("value")
    )
    return entries.select("node", "form", F.xxhash64("kind", "value").alias("value"))


def _counts(classes: DataFrame) -> DataFrame:
    """(value, df): values of several entries, and of how many."""
    return _entries(classes).groupBy("value").agg(F.count("*").alias("df")).where("df > 1")


def _index(classes: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Inverted lists (value, node, n, room, before): of each sketch the rarest values, enough for AGREE common ones.

    Sets up to WHOLE are listed whole; of n values they share 80 % at least with any linked set. Larger
    ones, and those that may be linked with larger ones, are listed by their K smallest values, of which
    linked sets share SHARED; the two kinds of lists are apart. In any common order of the values,
    the first `size - shared + AGREE` of two linked sets then agree in AGREE at least. Rare values
    come first, so lists of frequent values hold only sets that have little else. `room` is the largest
    number of common values with which this one can still be among the first AGREE of them.
    `before` has the high 32 bits of the node's values that come before this one. `counts` is `_counts`, stored.
    """
    entries = _entries(classes).join(_counts(classes) if counts is None else counts, "value")
    mine = Window.partitionBy("node", "form")
    is_whole, n = F.col("form") % 2 == 0, F.shiftright("form", 1)
    size = F.when(is_whole, n).otherwise(F.least(n, F.lit(K)))
    place = F.row_number().over(mine.orderBy("df", "value")) + size - F.count("*").over(mine)
    entries = entries.withColumn("room", size - place + AGREE)
    entries = entries.where(F.col("room") >= F.when(is_whole, F.ceil(n * 4 / 5)).otherwise(SHARED))
    room = F.when(is_whole, F.col("room").cast("int")).otherwise(n).alias("room")
    listed = entries.groupBy("node", "form").agg(F.array_sort(F.collect_list(F.struct("df", "value", room))).alias("list"))
    listed = listed.withColumn("n", n)
    high = F.transform("list.value", lambda v: F.shiftright(v, 32).cast("int"))
    listed = listed.select("node", "n", high.alias("high"), F.posexplode("list").alias("at", "e"))
    return listed.select("e.value", "node", "n", "e.room", F.slice("high", F.lit(1), F.col("at")).alias("before"))


def _sized(a: str, b: str) -> Column:
    """Sets of these sizes may have a similarity of 0.8."""
    return (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))


def _reached(room: str, a: str, b: str) -> Column:
    """Sets of these sizes have 4/9 of their sum in common at least, if linked, and `room` is enough for that."""
    return 9 * F.col(room) >= 4 * (F.col(a) + F.col(b))


def _stars(index: DataFrame) -> DataFrame:
    """Each list's members with CENTRES of them, those of smallest hashes, where the pair meets in MET lists.

    The hashes are of the members alone, so the lists of one family have most of their centres in common.
    These pairs only say which components to expect: one that is left out comes from `_across`, if it has a link.
    """
    def centre(salt: int) -> Column:
        return F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), "node", "n"))

    each = [centre(i) for i in range(CENTRES)]
    of = F.array_distinct(F.array(*[F.struct(c["node"].alias("other"), c["n"].alias("m")) for c in each]))
    pairs = index.join(index.groupBy("value").agg(of.alias("c")), "value").select("node", "n", F.inline("c"))
    pairs = pairs.where((F.col("node") != F.col("other")) & _sized("n", "m"))
    # A pair of centres meets twice in one list, once from each side.
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), (F.col("node") < F.col("other")).alias("up"))
    met = pairs.groupBy("a", "b").agg(F.count_if("up").alias("up"), F.count_if(~F.col("up")).alias("down"))
    return met.where(F.greatest("up", "down") >= MET).select("a", "b")


def _across(index: DataFrame, label: DataFrame, within: list[str]) -> DataFrame:
    """Pairs of one list with different labels that agree in AGREE values, stored.

    Members of a list's most frequent label are paired with the others only, not with each other: a
    list whose members are all linked gives none. Each pair comes once, from the list of the AGREE-th
    value they have in common. Of the values two linked sets share, the first AGREE leave each of them
    room for the rest, so an entry meets only sets of sizes for which its own is enough.
    """
    entries = index.join(label, "node", "left").withColumn("label", F.coalesce("component", "node"))
    keys = ["value", *within]
    counts = entries.groupBy(*keys, "label").agg(F.count("*").alias("size"))
    most = counts.groupBy(*keys).agg(F.max(F.struct("size", "label")).alias("most"), F.count("*").alias("labels"))
    # Stored, as are the pairs: the plans that read the lists twice would else hold all this twice.
    most = materialise(most.where("labels > 1"), "most")
    entries = entries.join(most, keys)
    others = entries.where("label <> most.label").select(
        *keys, F.col("node").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"), F.col("room").alias("rx"),
        F.col("before").alias("bx"),
    )
    pairs = entries.select(*keys, "node", "n", "label", "room", "before", (F.col("label") == F.col("most.label")).alias("main"))
    pairs = others.join(pairs, keys).where(_sized("n", "nx") & (F.col("label") != F.col("lx")))
    pairs = pairs.where(F.col("main") | (F.col("x") < F.col("node")))
    pairs = pairs.where(_reached("room", "n", "nx") & _reached("rx", "n", "nx"))
    pairs = pairs.where(F.size(F.array_intersect("bx", "before")) == AGREE - 1)
    pairs = pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    pairs = materialise(pairs, "across")
    release(index.sparkSession, most)
    return pairs


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketches leave a similarity of 0.8 possible, and whether they make it likely.

    Pairs carry the high halves of the values, in the same order. Two values of a set may have one half, so a
    pair of whole sets may lack one common value here; full sets confirm all that is kept.
    """
    side = classes.select("node", "n", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("sketch"))
    both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    exact = F.size(F.array_intersect("sa", "sb")) + 1
    ka, kb = F.slice("sa", 1, K), F.slice("sb", 1, K)
    union = F.slice(F.array_sort(F.array_union(ka, kb)), 1, K)
    common = F.size(F.array_intersect(F.array_intersect(ka, kb), union))
    whole = (F.col("na") <= WHOLE) & (F.col("nb") <= WHOLE)
    both = both.select("a", "b", "na", "nb", whole.alias("whole"), F.when(whole, exact).otherwise(common).alias("inter"))
    linked = 100 * F.col("inter") >= 80 * (F.col("na") + F.col("nb") - F.col("inter"))
    kept = both.where(F.when(F.col("whole"), linked).otherwise(F.col("inter") >= SHARED))
    return kept.select("a", "b", (F.col("whole") | (F.col("inter") >= LIKELY)).alias("likely"))


def _possible(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs whose full sets may have a similarity of 0.8, by the high 16 bits of their values alone.

    Of the common values of two sets as many bits differ at least, less those that either set has twice, so
    no link is left out; the bits are a quarter of what a pair would carry.
    """
    bits = F.array_distinct(F.transform("hashes", lambda v: F.shiftright(v, 48).cast("short")))
    side = full.select("node", F.size("hashes").alias("n"), bits.alias("bits"))
    both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    twice = F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb"))
    both = both.select("a", "b", (F.size(F.array_intersect("sa", "sb")) + twice).alias("most"), (F.col("na") + F.col("nb")).alias("sum"))
    return both.where("100 * most >= 80 * (sum - most)").select("a", "b")


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs whose full sets have a similarity of 0.8 or more."""
    pairs = materialise(_possible(pairs, full), "possible")
    release(pairs.sparkSession)
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("hashes").alias("sa")), "a")
    both = both.join(full.select(F.col("node").alias("b"), F.col("hashes").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", inter.alias("inter"), (F.size("sa") + F.size("sb")).alias("sum"))
    return both.where("100 * inter >= 80 * (sum - inter)").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by a similarity of 0.8 of their sets of word pairs.

    Letters A-Z count as lower case, words are runs of other bytes than white space. Returns a row per
    row of `docs`: the id, n_shingles, component_id (smallest id that can be reached) and kept (true for
    one row of each component) and set_id, the digest of the row's set. Documents without words stand
    alone. Null ids come after all others; a component of null ids only has a null component_id.

    Equal sets are one node. Inverted lists of retained values generate pairs: first every member of a
    list with one centre, then those that sketches leave in different components. Sketches of the
    union filter pairs and full sets confirm them. Where confirmation splits what the sketches had
    joined, the pairs between the parts are confirmed too, so no link between components is lost.
    """
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = materialise(texts.mapInArrow(_sets(K), _schema(kind)).withColumn("row", F.monotonically_increasing_id()), "sets")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "n", F.col("hashes").alias("sketch")))
    classes = sets.where("n > 0").groupBy("set_id").agg(first.alias("f"))
    classes = materialise(
        classes.select("set_id", F.col("f.row").alias("node"), "f.none", "f.id", "f.n", "f.sketch"), "classes"
    )
    rows = materialise(sets.select("id", "n", "set_id", "row"), "rows")
    release(docs.sparkSession, sets)
    counts = materialise(_counts(classes), "counts")
    release(docs.sparkSession)
    index = materialise(_index(classes, counts), "index")
    release(docs.sparkSession, counts)

    met = materialise(_stars(index), "met")
    stars = materialise(_estimated(met, classes), "pairs")
    release(docs.sparkSession, met)
    guess = components(stars.where("likely").select("a", "b"))
    across = _across(index, guess, [])
    others = materialise(_estimated(across, classes), "pairs")
    pairs = stars.union(others).select("a", "b")
    release(docs.sparkSession, across)

    used = materialise(
        pairs.select("a").union(pairs.select("b")).distinct().toDF("node").join(classes, "node").select("node", "set_id", "id"),
        "used",
    )
    wanted = used.select(F.col("id").alias("wanted"))
    full = texts.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    full = full.mapInArrow(_sets(None), _schema(kind)).select("set_id", "hashes").join(used.select("node", "set_id"), "set_id")
    full = materialise(full.dropDuplicates(["node"]).select("node", "hashes"), "full")

    release(docs.sparkSession)
    links = materialise(_verified(pairs, full), "links")
    found = components(links)
    # Nodes that likely links had joined and full sets have not: their lists are paired anew.
    split = guess.withColumnRenamed("component", "guess").join(found, "node", "left")
    split = split.withColumn("label", F.coalesce("component", "node"))
    parts = split.groupBy("guess").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    split = materialise(split.join(parts, "guess").select("node", "guess"), "split")
    across = _across(index.join(split, "node"), found, ["guess"])
    rest = materialise(_estimated(across, classes), "pairs")
    release(docs.sparkSession, index, stars, others, guess, split, across)
    more = materialise(_verified(rest.select("a", "b"), full), "links")
    if not more.isEmpty():
        parted, found = found, components(found.toDF("a", "b").union(more))
        release(docs.sparkSession, parted)
    release(docs.sparkSession, used, full, links, rest, more)

    label = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = label.select("set_id", "component", "none", "id", F.col("node").alias("row"))
    heads = label.groupBy("component").agg(F.min(F.struct("none", "id", "row")).alias("head"))
    label = label.join(heads, "component").select("set_id", "head")
    rows = rows.join(label, "set_id", "left")
    alone = F.col("n") == 0
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.col("row") == F.col("head.row")).alias("kept"), "set_id",
    )


def keep_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `near_duplicates` drops, also where several rows repeat an id."""
    per = found.groupBy(F.col(id_col).alias("__id")).agg(
        F.sum(F.col("kept").cast("int")).alias("__kept"), F.count("*").alias("__rows")
    )
    marked = docs.join(per.where("__kept > 0"), F.col(id_col).eqNullSafe(F.col("__id")))
    once = marked.where("__rows = 1").select(docs.columns)
    again = marked.where("__rows > 1").select(docs.columns)
    names, at = docs.columns, docs.columns.index(text_col)

    def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _sets(0)
        for batch in batches:
            text = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], names=["id", "text"])
            digests = [x.column(2) for x in sets(iter([text]))]
            counts = [x.column(1) for x in sets(iter([text]))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.concat_arrays(digests), pa.concat_arrays(counts)], names=[*names, "__set", "__n"]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField("__set", T.BinaryType()), T.StructField("__n", T.LongType())])
    again = again.mapInArrow(with_set, schema)
    kept = found.where("kept").select(F.col(id_col).alias("__id"), F.col("set_id").alias("__set_id")).distinct()
    again = again.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__set") == F.col("__set_id")), "left_semi")
    row = F.first(F.struct(*docs.columns)).alias("__row")
    one = again.where("__n > 0").groupBy(id_col, "__set").agg(row).select("__row.*")
    return once.unionByName(one).unionByName(again.where("__n = 0").select(docs.columns))

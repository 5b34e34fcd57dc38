"""Exact duplicates: filters of immutable snapshots screen the digests of a new batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm import fuse
from panelmill.llm.scan import flat
from panelmill.session import materialise

#: Digests in one bucket of a snapshot, about. Digests are spread evenly, so buckets are too.
BUCKET_ROWS = 50_000


def _digests(content: bool):
    """Arrow function: id and text to id and the SHA-256 of the text with A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, rows = flat(batch.column(1))
            texts = (data[a:b].tobytes().lower() for a, b in zip(rows[:-1], rows[1:]))
            if content:
                texts = list(texts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(texts, pa.binary()),
                ], names=["digest", "content"])
            else:
                found = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(2)], names=["id", "digest", "old"])

    return run


def _key(digest: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:16] for d in digest), np.uint64)


def _filter(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "filter": [fuse.build(_key(group["digest"]))]})


def _screen(new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hit = np.zeros(len(new), bool)
    if len(new):
        for filter_ in filters["filter"]:
            hit |= fuse.contains(filter_, _key(new["digest"]))
    return new.loc[hit, ["digest"]]


def _bucket(count: int) -> Column:
    """Bucket by the first 32 bits of the digest."""
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return F.pmod(head, F.lit(max(1, -(-count // BUCKET_ROWS)))).cast("int").alias("bucket")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("size"))


def _confirmed(texts: DataFrame, both: DataFrame) -> DataFrame:
    """Digests of both sides whose representatives agree in every byte."""
    ids = both.select("digest", F.explode(F.array("old_top", "new_top")).alias("wanted")).distinct()
    found = texts.join(ids.select("wanted").distinct(), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    found = found.select("id", "text").mapInArrow(_digests(True), "digest binary, content binary")
    found = found.join(ids.select("digest").distinct(), "digest", "left_semi").groupBy("digest")
    return found.agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a = b").select("digest")


def exact_duplicates(docs: DataFrame, old: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of rows whose texts agree after lower-casing A-Z; null texts are empty texts.

    `old` says which rows belong to the immutable snapshot; all others are the incoming batch. Returns
    a row per row: the id, keep_id (the group's largest id; null if all are), group_size, kept and
    digest (SHA-256). Rows that repeat the id that stays are all marked kept; `keep_rows` leaves one.

    Snapshot digests lie in buckets with a binary-fuse filter each. The batch is grouped by digest on
    its own, its digests meet the filter of their bucket, and only those that it lets through join
    the exact bucket, where the texts of both sides are compared byte by byte.
    """
    kind = docs.schema[id_col].dataType
    texts = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(old, F.lit(False)).alias("old"),
    )
    schema = T.StructType([T.StructField("id", kind), T.StructField("digest", T.BinaryType()), T.StructField("old", T.BooleanType())])
    rows = materialise(texts.mapInArrow(_digests(False), schema), "digests")

    snapshot = materialise(_grouped(rows.where("old")), "snapshot")
    batch = materialise(_grouped(rows.where("not old")), "batch")
    bucket = _bucket(max(snapshot.count(), batch.count()))
    filters = snapshot.select("digest", bucket).groupBy("bucket").applyInPandas(_filter, "bucket int, filter binary")
    positive = batch.select("digest", bucket).groupBy("bucket").cogroup(filters.groupBy("bucket"))
    positive = positive.applyInPandas(_screen, "digest binary")
    both = batch.join(positive, "digest", "left_semi").withColumnRenamed("top", "new_top")
    both = both.join(snapshot.select("digest", F.col("top").alias("old_top")), "digest")
    both = materialise(both.select("digest", "old_top", "new_top"), "matches")
    same = materialise(_confirmed(texts, both), "confirmed").withColumn("same", F.lit(True))

    groups = snapshot.withColumn("old", F.lit(True)).union(batch.withColumn("old", F.lit(False)))
    # A digest found on one side only, or confirmed on both, is one group.
    differs = both.join(same, "digest", "left_anti").select("digest", F.lit(True).alias("differs"))
    side = F.when(F.col("differs"), F.col("old")).otherwise(F.lit(True)).alias("side")
    groups = groups.join(differs, "digest", "left").select("digest", side, "top", "size")
    groups = groups.groupBy("digest", "side").agg(F.max("top").alias("keep_id"), F.sum("size").alias("group_size"))
    rows = rows.join(differs, "digest", "left").select("id", "digest", side)
    out = rows.join(groups, ["digest", "side"])
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest",
    )


def digest_of(text: Column) -> Column:
    """The digest that `exact_duplicates` groups by."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256))


def keep_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `exact_duplicates` drops; of rows that repeat an id and text one stays."""
    per = found.groupBy(F.col(id_col).alias("__id")).agg(
        F.sum(F.col("kept").cast("int")).alias("__kept"), F.count("*").alias("__rows")
    )
    marked = docs.join(per.where("__kept > 0"), F.col(id_col).eqNullSafe(F.col("__id")))
    once = marked.where("__rows = 1").select(docs.columns)
    # An id on several rows: whether a row stays depends on its own text.
    digests = found.where("kept").select(F.col(id_col).alias("__id2"), F.col("digest").alias("__digest2")).distinct()
    again = marked.where("__rows > 1").withColumn("__digest", digest_of(F.col(text_col).cast("string")))
    again = again.join(digests, F.col(id_col).eqNullSafe(F.col("__id2")) & (F.col("__digest") == F.col("__digest2")), "left_semi")
    again = again.groupBy("__id", "__digest").agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return once.unionByName(again)

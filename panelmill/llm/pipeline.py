"""A training corpus from a table of documents: five stages, each a table of its own.

All but the last return the columns of their input, whatever their names, and an empty table from an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import exact, langid, mixing, neardup, packing
from panelmill.session import materialise


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from the rows that name theirs.

    Null and empty texts and those without a letter are rejected. Every row is judged by its own text, so equal
    rows and rows that repeat an id are kept or dropped each. Where no row names a language, all are rejected.
    """
    return langid.only_known(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id.

    A null text equals an empty one, a null id is the smallest, and of rows equal in id and text one stays.
    """
    old = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    return exact.keep_rows(docs, materialise(exact.exact_duplicates(docs, old), "found"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Null and empty texts are linked with nothing and stay. A null id comes last; of rows equal in id and words
    one stays.
    """
    return neardup.keep_rows(docs, materialise(neardup.near_duplicates(docs), "found"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target of its source takes it.

    Null is a source of its own. Documents without words stay once. Rows that repeat an id within a source
    are taken together.
    """
    return mixing.mixed(docs, mixing.mix(docs)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens.

    A null or empty text is one piece, its end token. Rows that repeat an id are documents of their own.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("language ID", languages),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, sketches, hashed orders and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every result is stored before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

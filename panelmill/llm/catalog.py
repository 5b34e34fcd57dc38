"""Registered queries of the subpackage, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import (
    alignment, exact, fingerprints, langid, licenses, mixing, neardup, negatives, packing, pipeline, quality, substrings, token_counts, toxicity,
)

TOKENIZER = "word_bpe_49k.json"
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id has none and is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)), F.lit(-1))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.index(spark))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_remainder(4) != 2))
    return langid.identify(docs, model).withColumn("held_out", _remainder(4) == 2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), keep_ids=False)


def _classified(spark: SparkSession, sf_dir: str, method, threshold: float) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_remainder(5) != 0)
    scored = method.score(docs, method.fit(docs, labels))
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", predicted.alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by compression."""
    return _classified(spark, sf_dir, quality, 0.3)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated windows of 35 words."""
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"), hashed=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return _classified(spark, sf_dir, toxicity, 0.5)


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; half of the rows, by a hash of the id, are the snapshot."""
    found = exact.exact_duplicates(_table(spark, sf_dir, "documents"), _remainder(2) == 0)
    return found.withColumn("digest", F.lower(F.hex("digest"))).withColumnRenamed("digest", "text_sha256")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).drop("set_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers lie over each other in every document."""
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_fingerprints": op2_fingerprints,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_substrings": op6_substrings,
    "op7_toxicity": op7_toxicity,
    "op8_exact": op8_exact,
    "op9_neardup": op9_neardup,
    "op10_mixing": op10_mixing,
    "op11_negatives": op11_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_alignment": op13_alignment,
    "pipeline": pipeline.run,
}

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + {substrings.WINDOW - 1}], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substrings.WINDOW - 2})) AS i FROM d) x),
r AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM p JOIN r USING (s), range(0, {substrings.WINDOW}) u(k)),
k AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d) x
      ANTI JOIN c USING (doc_id, j)),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM k GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""

EXACT_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWER} AS t FROM documents) d WINDOW w AS (PARTITION BY t)"""

NEARDUP_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) > 1 THEN w[i] || ' ' || w[i + 1] ELSE w[1] END AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""

NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

ORACLES = {
    "op1_licenses": licenses.scan_sql(),
    "op6_substrings": SUBSTRINGS_SQL,
    "op8_exact": EXACT_SQL,
    "op9_neardup": NEARDUP_SQL,
    "op11_negatives": NEGATIVES_SQL,
}

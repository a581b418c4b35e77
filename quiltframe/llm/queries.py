"""The registered queries of this subpackage and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.llm import (
    decontaminate, hard_negatives, jaccard_join, language, line_rules, mixture, order_minhash, quality_model, repeats,
    secret_scan, token_alignment, toxicity, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets_found(_table(spark, folder, "documents"))


def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, folder, "documents")).drop("kept")


def op4_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(_table(spark, folder, "documents"))


def op5_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.edited_pairs(_table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality_model.score(docs, quality_model.train(docs))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, folder, "labels")))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    out = language.held_out(F.col("doc_id"))
    found = language.identify(docs, language.train(docs, learn=~out))
    return found.select(F.col("id").alias("doc_id"), language.held_out(F.col("id")).alias("held_out"),
                        "lang_pred", "score")


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.grouped(_table(spark, folder, "documents"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(_table(spark, folder, "pages"), payload=False).select(*warc.digest_columns())


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align(_table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """A seventh of the labels is moved by one, as noise."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, folder, "embeddings"), moved)


def op13_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judge(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_decontaminate, op2_secret_scan, op3_repeats, op4_mixture, op5_order_minhash, op6_quality, op7_toxicity,
    op8_language, op9_jaccard_join, op10_warc, op11_token_alignment, op12_hard_negatives, op13_line_rules)}

# Same rows as op10: what is written comes back.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m"""

_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256e0 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
near AS (SELECT * FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT n.anchor_id, n.id AS positive_id,
  (row_number() OVER (PARTITION BY n.anchor_id, n.id ORDER BY f.score DESC, f.id))::INTEGER AS rank,
  f.id AS negative_id, n.score AS positive_score, f.score AS negative_score
FROM near n JOIN p f ON f.anchor_id = n.anchor_id AND NOT f.same
  AND 50 * n.score <= 100 * f.score AND 100 * f.score <= 95 * n.score
QUALIFY row_number() OVER (PARTITION BY n.anchor_id, n.id ORDER BY f.score DESC, f.id) <= 3"""

ORACLES: dict[str, str] = {
    "op2_secret_scan": secret_scan.duck_sql(),
    "op10_warc": _WARC,
    "op12_hard_negatives": _NEGATIVES,
    "op13_line_rules": line_rules.duck_sql(),
}

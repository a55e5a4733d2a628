"""The queries of this subpackage, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe_transducer, exact_dedup, hard_negatives, langid, near_dedup, packing, periodic_runs, sentencepiece_lattice, sharding, toxicity, url_filter, warc
from .common import small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = warc.archive_pages(_read(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark, 2000)
    return sentencepiece_lattice.encode_digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _read(spark, sf_dir, "documents")
    return toxicity.detect(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_read(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark))


def op9_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(_read(spark, sf_dir, "documents"), packing.Packing.public())


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), near_dedup.Forest(words=4))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return periodic_runs.runs_digest(_read(spark, sf_dir, "documents"))


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return bpe_transducer.encode_digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_vantage_point, op2_warc, op3_language_id, op4_url_filter, op5_sentencepiece, op6_toxicity, op7_rendezvous, op8_exact_dedup, op9_lexical_packing, op10_lsh_forest,
        op11_periodic_runs, op12_bpe_transducer, op13_hard_negatives,
    )
}

ORACLE: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f""",
    "op8_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS cp,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS d
            FROM documents),
        k AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY d ORDER BY cp DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY d) AS group_size
            FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d AS text_sha256 FROM k""",
    "op13_hard_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
        s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_dot_product(a.v, r.v)::BIGINT AS score
            FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
            FROM p JOIN s USING (anchor_id)
            WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}

"""The queries and SQL of this subpackage, registered by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, lm, mixing, pii, resampling, secrets, simhash, spelling, substrings, tokens, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every url of ``pages``."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the shards that all ``documents`` are written to."""
    return tokens.training_order(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of ``benchmark`` in every text of ``documents``."""
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every text of ``documents``; has_repeats and removed_ranges say it plainly."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    ranges = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s[0], s[1])), ",")
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"), ranges.alias("removed_ranges"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each of ``documents``."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    return pii.summary(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of all ``documents``."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all ``embeddings``."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``."""
    return secrets.summary(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of all ``documents`` drawn towards ``benchmark``."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all ``documents``."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all ``documents`` with their near words, forms and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_training_order": op2_training_order,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_embeddings": op8_embeddings,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
    "op11_resampling": op11_resampling,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_spelling": op13_spelling,
}
ORACLE_SQL: dict[str, str] = {
    "op5_mixing": r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), r AS (
    SELECT *, md5(concat_ws(':', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))) AS digest FROM d
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), f AS (
    SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
        coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cap_before,
        (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weight_from
    FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)
), l AS (
    SELECT *, CASE WHEN NOT weight * ((total - cap_before) / weight_from) >= cap THEN (total - cap_before) / weight_from END AS own FROM f
), t AS (
    SELECT source, source_size, coalesce(weight * min(own) OVER (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING), cap) AS target, cap, weight, own,
        first_value(own IGNORE NULLS) OVER (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING) AS level
    FROM l
), g AS (
    SELECT source, source_size, coalesce(weight * level, cap) AS target FROM t
), h AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS copies FROM g
), c AS (
    SELECT r.doc_id, r.size, h.source_size, h.target, h.copies, CAST(round(h.target) AS BIGINT) - h.copies * h.source_size AS extra,
        coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.digest, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source
)
SELECT doc_id, size, source_size, target, CAST(copies * size + greatest(0, least(size, extra - before)) AS BIGINT) AS taken FROM c
""",
}

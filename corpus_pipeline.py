"""Raw documents to training shards: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, mixing, simhash, tokens, toxicity
from vellum.llm.staging import release, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of ``toxicity`` doesn't reject; null and empty texts are judged like any other."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near duplicates; rows without a doc_id stay."""
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; the last of a source may be cut to some of its words."""
    return mixing.mix(docs)


def order_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the training shards, which are written to the shared folder; an empty table has none."""
    return tokens.training_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("source mixing", mix_sources),
    ("token ids", order_tokens),
]

#: The first stage fits a classifier, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder before the next one reads it, and
    deleted once that has written its own. The last stage has written its shards and their manifest when it returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, step) in enumerate(STAGES):
        before, docs = docs, step(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{place}")
        if place:
            release(before)
    return docs

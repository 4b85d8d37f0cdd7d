"""The corpus pipeline: quality rules, near-duplicates, secrets, source weights, token ids, each a stage over all rows.

Odd rows: null and blank texts have no words, so the first stage drops them; a null id stays through all stages (it
names no component, is mixed by its size, and its row of ids has a null id); repeated rows are one document to the
near-duplicate stage, which keeps one; very long texts go through whole; extra columns are carried along, whatever
their names, up to the last stage; an empty table gives empty stages. The folders that `run` writes to stay in the
shared folder, as its result is read from the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, neardup, pieces, quality, secrets
from tessera.llm.common import fresh_dir


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose over half of their words."""
    return _counted(quality.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays."""
    return neardup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; no document goes."""
    return _counted(secrets.redact(docs, secrets.train(secrets.sample() + secrets.labelled(docs))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless): a row for each row of the mix."""
    return pieces.encoded(docs)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("secret scans", secret_scan), ("source mix", mix_sources), ("sentencepiece", encode)]

#: SQL has neither the fingerprints' hash nor the merges; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_dir(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

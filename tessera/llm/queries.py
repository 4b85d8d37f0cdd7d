"""One query an operator, with production parameters over the whole table it is made for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kneser_ney, licenses, mixing, neardup, pieces, quality, secrets, sharding, topk, warc
from tessera.llm.common import fresh_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    got = topk.top_k(vectors, vectors.where("id % 50 = 0"), k=5)
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    model = kneser_ney.train(docs.where(fold != 2))
    got = kneser_ney.score(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return got.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeat_words").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_lost_words").alias("lost_words"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.taken(table(spark, sf_dir, "documents"))
    return got.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to monolithic archives, those to a member a record, and these read back."""
    mono = warc.write_monolithic(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc-mono"))
    archives = fresh_dir(spark, "warc")
    warc.normalise(spark, mono, archives)
    return warc.read(spark, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.sample() + secrets.labelled(docs))).select("doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_maxscore_topk, op2_sentencepiece, op3_license_scan, op4_kneser_ney, op5_shard_documents, op6_simhash_dedup, op7_quality_rules, op8_mix_sources, op9_warc, op10_secret_scan)}

"""What queries share: tables, lines and windows of documents, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import tokens as K
from tessera.operators import chunking


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, seq, line)."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("seq", "line")).withColumn("seq", F.col("seq").cast("long"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, window, content, word_count)."""
    return chunking.windows(table(spark, sf_dir, "documents"))


def firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, heading, content): a document's first line and the rest."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.split(t, "\n")[0].alias("heading"), F.regexp_replace(t, r"(?s)\A[^\n]*\n?", "").alias("content"))


LINES = "(SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)"
FIRSTS = r"(SELECT doc_id, string_split(text, chr(10))[1] AS heading, regexp_replace(text, '(?s)\A[^\n]*\n?', '') AS content FROM documents)"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
WINDOWS = f"(SELECT doc_id, i AS \"window\", array_to_string(w[i * 200 + 1 : i * 200 + 200], ' ') AS content, len(w[i * 200 + 1 : i * 200 + 200])::BIGINT AS word_count FROM (SELECT doc_id, w, unnest(range(0, ceil(len(w) / 200.0)::BIGINT)) AS i FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)))"
# Words of the survey, written out here so that the SQL doesn't read what it checks.
OPENERS = "('and', 'but', 'because', 'so', 'then', 'therefore', 'however', 'also', 'instead', 'meanwhile', 'moreover', 'otherwise', 'plus', 'yet', 'thus')"
LIGHT = "('this', 'that', 'these', 'those', 'it', 'they', 'them', 'their', 'its')"
STOP = "[" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + "]"
RAW = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
PLAIN = f"list_filter({RAW}, lambda t: len(t) > 1 AND NOT list_contains({STOP}, t))"
STEM = "CASE WHEN len(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN len(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END"
STEMMED = f"list_transform({RAW}, lambda t: {STEM})"
STRIP = r"regexp_replace({0}, '\A\s+|\s+\z', '', 'g')"
COUNT = f"len({WORDS})"

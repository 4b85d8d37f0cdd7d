"""Sinks: JSON lines, CSV reports, index tables, side outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Validation


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def csv_report(df: DataFrame, path: str) -> None:
    """Nested columns as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def json_report(summary: DataFrame, results: DataFrame, path: str) -> None:
    """A summary's row and the results' rows, each as a JSON line of its own kind."""
    one = summary.select(F.lit("summary").alias("kind"), F.to_json(F.struct("*")).alias("value"))
    rows = results.select(F.lit("result").alias("kind"), F.to_json(F.struct("*")).alias("value"))
    one.unionByName(rows).write.mode("overwrite").partitionBy("kind").text(path)


def save_index(index: dict[str, DataFrame], name: str, buckets: int = 64) -> None:
    """Postings and terms as tables bucketed by term, so that queries join them without a shuffle of theirs."""
    for part in ("postings", "terms"):
        index[part].write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(f"{name}_{part}")
    index["stats"].write.mode("overwrite").saveAsTable(f"{name}_stats")


def load_index(spark: SparkSession, name: str, tokenizer: str | None = None) -> dict[str, DataFrame]:
    out = {part: spark.table(f"{name}_{part}") for part in ("postings", "terms", "stats")}
    made = out["stats"].first()["tokenizer"]
    if tokenizer and tokenizer != made:
        raise ValueError(f"the index was made by tokenizer {made!r}, not {tokenizer!r}")
    return out


def save_vectors(index: DataFrame, path: str, dims: tuple[int, ...] = ()) -> None:
    """Vectors, also cut to smaller sizes, in a folder a size."""
    from tessera.operators.search import unit

    for d in dims or (0,):
        df = index if not d else index.withColumn("vec", unit(F.col("vec"), d))
        df.withColumn("dim", F.size("vec")).write.mode("append" if d and d != dims[0] else "overwrite").partitionBy("dim").parquet(path)


def side_outputs(judged: DataFrame, path: str, v: Validation = Validation()) -> None:
    """All chunks, those flagged and those suspicious, each in a folder."""
    score = F.col("quality.overall")
    judged.write.mode("overwrite").json(f"{path}/all")
    judged.where((score < v.flag_below) | (F.size("issues") > 0)).write.mode("overwrite").json(f"{path}/flagged")
    judged.where(score < v.suspicious_below).write.mode("overwrite").json(f"{path}/suspicious")


def tree_json(chunks: DataFrame) -> DataFrame:
    """(level1, json): a nested document of each top level, with its levels and chunk ids."""
    none = lambda c: F.coalesce(F.col(c), F.lit("(none)")).alias(c)
    three = chunks.groupBy(none("level1"), none("level2"), none("level3")).agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
    two = three.groupBy("level1", "level2").agg(F.sort_array(F.collect_list(F.struct("level3", "chunk_ids"))).alias("children"))
    return two.groupBy("level1").agg(F.sort_array(F.collect_list(F.struct("level2", "children"))).alias("children")).select("level1", F.to_json(F.struct("level1", "children")).alias("json"))


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_sources(df: DataFrame, path: str) -> None:
    """Writes by source and replaces the folders of the sources that `df` has, no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(path)

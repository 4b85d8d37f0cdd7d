"""Incremental ingest and rewards by Structured Streaming; each equals its batch form."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import relational, tuning


def source(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def insert_absent(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, schema) -> StreamingQuery:
    """Appends rows whose keys the table at `path` doesn't have; of equal keys in a batch the first by `order`.

    A batch that is run again after a failure finds its rows there and appends none.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old = spark.createDataFrame([], schema)
        relational.absent(relational.first_of(batch, keys, order), old, keys).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items not yet done."""
    return relational.absent(items, done, [key])


def rewards(stream: DataFrame, arm: str, reward: str, name: str, checkpoint: str) -> StreamingQuery:
    """Arms' posteriors, kept up to date in an in-memory table."""
    return tuning.beta_posterior(stream, arm, reward).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): an extension, with a watermark for late events; also runs in batch."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def conversations(turns: DataFrame, urgent: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, title, category, turns, user_turns): title: the first user turn's 52 first characters; urgent by phrases."""
    user = F.col("role") == "user"
    hit = F.exists(F.array(*map(F.lit, urgent)), lambda p: F.contains(F.lower("text"), p)) if urgent else F.lit(False)
    return turns.groupBy("conv_id").agg(F.left(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))), F.lit(52)).alias("title"), F.when(F.coalesce(F.bool_or(user & hit), F.lit(False)), "urgent").otherwise("general").alias("category"), F.count("*").alias("turns"), F.count_if(user).alias("user_turns"))

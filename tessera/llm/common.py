"""What the corpus operators share: word rules, the shared folder, ranks that need no single task."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a new one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a checkpoint in the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of the session's queries hold `size` bytes at most from here on: a worker has one or two of them, and the JVM another for each of its tasks."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) > size or not re.fullmatch(r"\d+b?", spark.conf.get(name)):
        spark.conf.set(name, f"{size}b")


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches in pieces of `rows`, so that what a worker makes of them stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def without(text: Column, chars) -> Column:
    """`text` without the given single characters; each is a plain byte search, with no regex."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def ranked(df: DataFrame, by: list[str], order: list[str], name: str, bucket: Column, weight: str | None = None) -> DataFrame:
    """Adds `name`, the number of rows (or the sum of `weight`) before each row of its group `by`.

    The order is `bucket`, then `order`; the columns of `by` hold no nulls. Groups may hold most of all
    rows: rows are ranked within (group, bucket), where buckets are small, and only the buckets' sums are
    added up along a group. Ties of `order` may fall either way.
    """
    size = F.lit(1).cast("long") if weight is None else F.col(weight)
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(*by, "_bucket").agg(F.sum(size).alias("_in"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, "_bucket", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("_own", F.coalesce(F.sum(size).over(within), F.lit(0))).join(sums, [*by, "_bucket"])
    return out.withColumn(name, (F.col("_base") + F.col("_own")).cast("long")).drop("_bucket", "_own", "_base")


def hot_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, parts: int = 256) -> DataFrame:
    """`rows` joined with `groups` (a row a `key`, `size` rows of `rows` each), without a task that gets a hot group's rows.

    A group of more than 1/`parts` of all `total` rows is hot; there are fewer than `parts` of these, so they are
    sent to where their rows are. The others meet by a shuffle.
    """
    most = max(total // parts, 1000)
    hot, cool = F.broadcast(groups.where(F.col(size) > most)), groups.where(F.col(size) <= most)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cool, key))

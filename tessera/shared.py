"""The folder that driver and executors share, and lineage cut by what is written there."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on one machine a new folder where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` as it is once written to the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of the session's queries hold `size` bytes at most from here on."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) > size or not re.fullmatch(r"\d+b?", spark.conf.get(name)):
        spark.conf.set(name, f"{size}b")

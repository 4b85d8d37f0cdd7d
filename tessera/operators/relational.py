"""Set operations of chunk stores: first of duplicates, upsert, replacement, unions, joins by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.shared import cut


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in `order`. dropDuplicates doesn't say which row stays."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose keys `old` doesn't have."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(absent(new, old, keys), allowMissingColumns=True)


def replace_by_source(old: DataFrame, new: DataFrame, source: str = "source_file") -> DataFrame:
    """`old` without the sources of `new`, case aside, and `new`."""
    gone = new.select(F.lower(source).alias("_s")).distinct()
    return old.join(gone, F.lower(source) == F.col("_s"), "left_anti").unionByName(new, allowMissingColumns=True)


def append(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ordered_union(a: DataFrame, b: DataFrame, key: str, rank: str) -> DataFrame:
    """(key, place): keys of both lists once, those of `a` first, each list in order of its rank."""
    both = a.select(key, F.lit(0).alias("_l"), rank).unionByName(b.select(key, F.lit(1).alias("_l"), rank))
    one = both.groupBy(key).agg(F.min(F.struct("_l", rank)).alias("o"))
    return numbered(one, ["o", key], "place").select(key, "place")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with `name`, each row's place (from 1) in `order`, without one task for all rows.

    Rows are sorted by ranges and written, and each range's places are moved on by the rows of the ranges before it:
    a row a range. Ties fall either way.
    """
    rows = cut(df.orderBy(*order)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def zipped(left: DataFrame, right: DataFrame, by: list[str], order: list[str], how: str = "inner") -> DataFrame:
    """Rows of both tables paired by their place in each group of `by`, in order of `order`, which both have; the right side's other columns are added.

    Places are safer than positions in files, but only as good as the order: pair by a key where there is one.
    """
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    extra = [c for c in right.columns if c not in (*by, *order)]
    return left.withColumn("_place", place).join(right.select(*by, *extra, place.alias("_place")), [*by, "_place"], how).drop("_place")


def null_safe_left(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`left` with the columns of `right`, nulls equal nulls; of equal keys the last in `order`."""
    last = right.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_rn = 1").drop("_rn")
    renamed = last.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in last.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, "left").drop(*[f"_r_{k}" for k in keys])


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random rows."""
    return df.orderBy(F.rand(seed)).limit(n)


def row_slice(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows `first` to `last` (from 1) in order; only those are kept from each partition."""
    return df.orderBy(*order).offset(first - 1).limit(last - first + 1)


def by_number_suffix(df: DataFrame, key: str) -> DataFrame:
    """Ordered by the number in ids such as q12."""
    return df.orderBy(F.regexp_extract(key, r"(\d+)$", 1).cast("long"), key)

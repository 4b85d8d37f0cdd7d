"""Sharding by balanced label propagation [native].

Documents of one link group (here: of equal texts) are linked. Every document starts in a shard by its
hash; then, round by round, linked documents move to the shard that holds most of their group, as far as
that shard's quota goes, and at last documents without links fill the shards up, so that the counts of
rows differ by one at most. Only DataFrame operations run here.

A group that exceeds a shard's quota fills one shard after another, a shard a round. Nulls: a null text is
the empty one (size 1); rows of a null group are unlinked. Repeated rows are placed one by one. An empty table
gives no rows. The only tables that are gathered have a row a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut, hot_join, ranked


def quota(total: int, shards: int) -> Column:
    """Rows that each shard of column `shard` holds in the end."""
    return (F.lit(total // shards) + (F.col("shard") < total % shards).cast("int")).cast("long")


def grouped(nodes: DataFrame, total: int) -> DataFrame:
    """Adds members, the rows of the row's group (1 where the group is null), and hot, whether those are over 1/256 of all."""
    sizes = nodes.where("grp is not null").groupBy("grp").agg(F.count("*").alias("members"))
    several = hot_join(nodes.where("grp is not null"), sizes, "grp", "members", total)
    out = several.unionByName(nodes.where("grp is null").withColumn("members", F.lit(1).cast("long")))
    return out.withColumn("hot", F.col("members") > max(total // 256, 1000))


def _giants(linked: DataFrame, counts: DataFrame, room: DataFrame) -> DataFrame:
    """Rows of hot groups with best and asks: a group's homes are the shards it has most rows in, as many as its rows need.

    Rows outside of them ask for their room in turn. There are fewer than 256 hot groups, so their counts are small.
    """
    names = [c for c in linked.columns if c != "moved"]
    down = W.partitionBy("grp").orderBy(F.col("n").desc(), "shard").rowsBetween(W.unboundedPreceding, -1)
    free, none = F.greatest("room", F.lit(0)), F.lit(0)
    homes = counts.join(F.broadcast(room), "shard").withColumn("all", F.sum("n").over(W.partitionBy("grp"))).withColumn("low", F.coalesce(F.sum(free).over(down), none)).withColumn("held", F.col("low") + F.coalesce(F.sum("n").over(down), none))
    homes = F.broadcast(homes.where("held < `all`").select(F.col("grp").alias("g"), F.col("shard").alias("best"), "low", (F.col("low") + free).alias("high")))
    rows = linked.join(homes.select(F.col("g").alias("grp"), F.col("best").alias("shard"), F.lit(True).alias("home")), ["grp", "shard"], "left")
    stay = rows.where("home").select(*names, F.lit(None).cast("int").alias("best"), F.lit(False).alias("asks"))
    away = ranked(rows.where("home is null"), ["grp"], ["h"], "r", F.shiftright("h", 52))
    away = away.join(homes, (F.col("grp") == F.col("g")) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high")), "left")
    return stay.unionByName(away.select(*names, "best", F.col("best").isNotNull().alias("asks")))


def propagate(nodes: DataFrame, shards: int = 16, rounds: int = 12) -> DataFrame:
    """`nodes` (columns h, a 64-bit hash of the row, and grp, its link group or null) with `shard` and `slot` added.

    A round: count each group's rows in each shard (a partial count, so a hot group is a row a task and shard);
    per group, take the shard with room that has most of them; rows outside of it ask to move there; those
    asking are ranked per shard, rows of a group together, and as many as there is room for move. A hot group
    may fill several shards: those it has most rows in, as many as its rows need. Rounds end when nothing
    moves, or after `rounds`.
    """
    nodes = cut(nodes)
    total = nodes.count()
    nodes = cut(grouped(nodes, total))
    giant = (nodes.agg(F.max("members")).first()[0] or 0) > total // shards
    here = F.pmod("h", F.lit(shards)).cast("int")
    linked = nodes.where("members > 1").withColumn("shard", here).withColumn("moved", F.lit(False))
    near = F.shiftright(F.xxhash64("grp"), 56) * 256 + F.pmod(F.shiftright("h", 8), F.lit(256))
    each = nodes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    for _ in range(rounds):
        names = [c for c in linked.columns if c != "moved"]
        counts = linked.groupBy("grp", "hot", "shard").agg(F.count("*").alias("n"))
        # a shard's room is a row a shard: at most `shards` rows
        inside = each.join(linked.groupBy("shard").agg(F.count("*").alias("in")), "shard", "left")
        room = inside.select("shard", (quota(total, shards) - F.coalesce("in", F.lit(0))).alias("room"))
        most = F.max(F.struct("n", -F.pmod(F.xxhash64("grp", "shard"), F.lit(1 << 30)), "shard"))
        best = counts.join(F.broadcast(room), "shard").where("room > 0").groupBy("grp", "hot").agg(most.alias("b")).select("grp", "hot", F.col("b.shard").alias("best"))
        full = F.broadcast(room.where("room <= 0").select("shard", F.lit(True).alias("full")))
        warm = linked.where("not hot").join(best.where("not hot").drop("hot"), "grp", "left")
        if not giant:  # fewer than 256 groups are hot: a row each is sent to where their rows are
            warm = warm.unionByName(linked.where("hot").join(F.broadcast(best.where("hot").drop("hot")), "grp", "left"))
        # a row in a full shard stays: it is with the part of its group that filled the shard
        asks = warm.join(full, "shard", "left").withColumn("asks", F.col("best").isNotNull() & (F.col("best") != F.col("shard")) & F.col("full").isNull()).select(*names, "best", "asks")
        if giant:
            asks = asks.unionByName(_giants(linked.where("hot"), counts.where("hot"), room))
        moving = ranked(asks.where("asks"), ["best"], ["h"], "r", near).join(F.broadcast(room.withColumnRenamed("shard", "best")), "best")
        gone = F.col("r") < F.col("room")
        moved = moving.withColumn("shard", F.when(gone, F.col("best")).otherwise(F.col("shard"))).select(*names, gone.alias("moved"))
        linked = cut(asks.where("not asks").select(*names, F.lit(False).alias("moved")).unionByName(moved))
        if linked.where("moved").isEmpty():
            break
    kept = cut(ranked(linked.drop("moved"), ["shard"], ["h"], "r", near).withColumn("stays", F.col("r") < quota(total, shards)).drop("r"))
    pool = kept.where("not stays").drop("stays", "shard").unionByName(nodes.where("members = 1")).withColumn("one", F.lit(0))
    nearly = F.when(F.col("members") > 1, F.shiftright(F.xxhash64("grp"), 58) * 64 + F.pmod("h", F.lit(64))).otherwise(F.lit(4096) + F.shiftright("h", 52))
    pool = ranked(pool, ["one"], ["h"], "r", nearly)
    stay = each.join(kept.where("stays").groupBy("shard").agg(F.count("*").alias("in")), "shard", "left")
    holes = stay.withColumn("hole", quota(total, shards) - F.coalesce("in", F.lit(0))).withColumn("to", F.sum("hole").over(W.orderBy("shard"))).select("shard", (F.col("to") - F.col("hole")).alias("from"), "to")
    filled = pool.join(F.broadcast(holes), (F.col("r") >= F.col("from")) & (F.col("r") < F.col("to"))).select(*nodes.columns, "shard")
    done = kept.where("stays").select(*nodes.columns, "shard").unionByName(filled)
    return ranked(done, ["shard"], ["h"], "slot", F.shiftright("h", 52)).drop("hot")


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 12, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, grp, members, shard, slot): documents with equal texts are linked."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    nodes = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("grp"), F.xxhash64(F.col(f"`{key}`")).alias("h"))
    return propagate(nodes, shards, rounds)


def cut_share(placed: DataFrame) -> DataFrame:
    """One row: links (pairs within groups) and those whose ends are in two shards."""
    per = placed.where("members > 1").groupBy("grp", "shard").agg(F.count("*").alias("n"))
    pairs = per.groupBy("grp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    return pairs.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("links"), F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("same")).cast("long").alias("cut"))

"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a keyed hash and laid end to end; the row of words is cut into
blocks of equal size. Slot k of the schedule is the point frac((k + 1/2) * g), g the golden ratio's
fraction; the point falls into one source's interval of the cumulative target weights, and the slots of a
source, ranked in schedule order, take its blocks in turn, starting anew when they are through.

Rules for odd rows: a null text has size 0, is placed and never taken; a null source is a source of its
own, last in order; repeated rows are documents of their own; an empty table gives an empty mix. Documents
of a null id are placed by their size's hash, those of one size next to each other. Very long texts are counted whole and
span several blocks. Columns other than id, text and source play no part, whatever their names. Ranks never gather a
source in one task: see `ranked`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, ranked

GOLDEN = 0.6180339887498949
CELLS = 1024


@dataclass(frozen=True)
class Mix:
    """weights: dealt to the sources in code-point order, repeating; budget: words of the mix by words there are;
    most: how often a source may be taken; block: words of a block; seed: of the shuffle; slot_bucket, doc_bucket:
    slots that one ranking step holds together; doc_buckets: parts that a source's documents are ranked in."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    budget: float = 1.5
    most: float = 2.0
    block: int = 512
    seed: int = 17
    slot_bucket: int = 4096
    doc_buckets: int = 4096


def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, src, s, null_src, size): words of each whole text; (s, null_src) stands for src in joins."""
    src = F.col(f"`{source}`").cast("string")
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(f"`{key}`").alias("key"), src.alias("src"), F.coalesce(src, F.lit("")).alias("s"), src.isNull().alias("null_src"), size.alias("size"))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(src, source_size, target, words, low, high): a row a source.

    Sources that would pass `most` times their size stop there and the rest is shared again by weight, until
    none is above: with sources in the order of most * size / weight, the first k are capped, for the least k
    that leaves a share no source after them exceeds. low, high: the source's part of the unit interval; words:
    the target as whole words. This table has a row a source and is the only one ordered as a whole.
    """
    per = sizes.groupBy("src", "s", "null_src").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("src").asc_nulls_last())
    weights = F.array(*[F.lit(float(x)) for x in mix.weights])
    per = per.withColumn("w", F.element_at(weights, ((F.row_number().over(order) - 1) % len(mix.weights) + 1).cast("int"))).withColumn("cap", F.lit(mix.most) * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    every = W.partitionBy()
    done = by.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("total", F.lit(mix.budget) * F.sum("source_size").over(every)).withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(done), F.lit(0.0))).withColumn("words_left", F.col("total") - F.coalesce(F.sum("cap").over(done), F.lit(0.0)))
    per = per.withColumn("level", F.col("words_left") / F.col("w_left"))
    # the level of the first source that isn't capped holds for all after it
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("src").isNull(), F.col("src"), F.col("level").alias("level")))).over(every)
    per = per.withColumn("free", free["level"]).withColumn("target", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("free") * F.col("w"))))
    up = order.rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumn("all", F.sum("target").over(every)).withColumn("high", F.sum("target").over(up) / F.col("all"))
    low = F.coalesce(F.lag("high").over(order), F.lit(0.0))
    last = F.lead("target").over(order).isNull()
    return per.select("src", "s", "null_src", "source_size", "target", F.round("target").cast("long").alias("words"), F.col("all"), low.alias("low"), F.when(last, F.lit(1.0)).otherwise(F.col("high")).alias("high"))


def placed(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(key, src, s, null_src, size, start, end): where each document lies in its source's shuffled row of words."""
    hashed = sizes.withColumn("h", F.xxhash64(F.lit(mix.seed), "key", "size"))
    out = ranked(hashed, ["s", "null_src"], ["h", "key", "size"], "start", F.pmod("h", F.lit(mix.doc_buckets)), "size")
    return out.withColumn("end", F.col("start") + F.col("size")).drop("h")


def schedule(per: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(slot, s, null_src, rank, epoch, block, at, length): the words [at, at + length) of its source that a slot takes.

    There are as many slots as blocks in the budget. A source's blocks are taken in order of its slots' ranks;
    the slot that reaches its target is cut to it and later ones are left out. Where the points gave a source
    fewer slots than its target needs (a short last block, the points' discrepancy, a very small source), the
    missing ones follow the schedule's end.
    """
    words = per.agg(F.sum("words")).first()[0] or 0
    slots = -(-words // mix.block)
    count = F.ceil(F.col("source_size") / F.lit(mix.block)).cast("long")
    whole = F.floor(F.col("words") / F.col("source_size"))
    per = per.where("words > 0").withColumn("count", count).withColumn("need", whole * count + F.ceil((F.col("words") - whole * F.col("source_size")) / F.lit(mix.block)))
    per = per.select("s", "null_src", "source_size", "words", "low", "high", "count", "need")
    cells = F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell")
    points = per.sparkSession.range(slots).select(F.col("id").alias("slot"), (((F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)) % F.lit(1.0)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(per.select("*", cells), "cell").where("u >= low and u < high").select("slot", "s", "null_src", "source_size", "words", "count")
    hit = ranked(hit, ["s", "null_src"], ["slot"], "rank", F.floor(F.col("slot") / mix.slot_bucket))
    got = hit.groupBy("s", "null_src").agg(F.count("*").alias("got"))
    short = per.join(got, ["s", "null_src"], "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    tail = short.select("s", "null_src", "source_size", "words", "count", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank")).withColumn("slot", F.lit(slots) + F.col("rank"))
    every = hit.unionByName(tail).withColumn("epoch", F.floor(F.col("rank") / F.col("count"))).withColumn("block", F.col("rank") % F.col("count")).withColumn("at", F.col("block") * mix.block)
    length = F.least(F.lit(mix.block), F.col("source_size") - F.col("at"), F.col("words") - F.col("epoch") * F.col("source_size") - F.col("at"))
    return every.withColumn("length", length).where("length > 0").select("slot", "s", "null_src", "rank", "epoch", "block", "at", "length")


def taken(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, src, size, source_size, target, taken): a row a document; taken: its words in the mix, repeats counted."""
    sizes = cut(sized(docs, text, source, key))  # the texts are read once
    per = targets(sizes, mix)
    # slots that take the same words are one row, with the number of times
    times = schedule(per, mix).groupBy("s", "null_src", "block", "at", "length").agg(F.count("*").alias("times"))
    spans = F.sequence(F.floor(F.col("start") / mix.block), F.floor((F.col("end") - 1) / mix.block))
    pieces = placed(sizes, mix).where("size > 0").select("*", F.explode(spans).alias("block"))
    both = F.greatest(F.lit(0), F.least("end", F.col("at") + F.col("length")) - F.greatest("start", "at"))
    # (source, start) tells the documents that have words apart
    got = pieces.join(times, ["s", "null_src", "block"], "left").groupBy("s", "null_src", "start", "key", "size").agg(F.sum(F.coalesce(both * F.col("times"), F.lit(0))).cast("long").alias("taken"))
    none = sizes.where("size = 0").select("s", "null_src", "key", "size", F.lit(0).cast("long").alias("taken"))
    p = per.select("src", "s", "null_src", "source_size", "target")
    return got.drop("start").unionByName(none).join(p, ["s", "null_src"]).select("key", "src", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix as whole documents: each row of `docs` as often as its share of taken words, rounded half up.

    A document that the mix takes 1.5 times is there twice, one that it takes 0.4 times isn't there. Rows of
    one id count as one document here.
    """
    got = taken(docs, mix, text, source, key).groupBy("key").agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    times = got.select(F.col("key").alias("_key"), F.floor(F.col("_taken") / F.col("_size") + 0.5).cast("int").alias("_times")).where("_times > 0")
    out = docs.join(times, F.col(f"`{key}`").eqNullSafe(F.col("_key")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).drop("_copy")

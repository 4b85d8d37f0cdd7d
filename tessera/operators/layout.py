"""Structure of documents from blocks or lines: repeated margins, headings, hierarchy, sections.

A block has source_file, page_index, block_index, text, min_y, max_y, max_font_size, is_bold, doc_item_type
and heading_level; order is (page_index, block_index). State that a reader would carry along a document is a
window over its blocks, so a document is one window partition and no more than that is ever held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import Cleaning, Headings
from tessera.functions import predicates as P
from tessera.functions import text as T

# Words that start body text rather than a heading.
BODY_STARTS = (
    "a additionally after also although an and because before but furthermore he hence however if it moreover or she so that the then therefore these they this those thus we when you"
).split()


def repeated_margins(blocks: DataFrame, c: Cleaning = Cleaning()) -> DataFrame:
    """(source_file, norm, header, footer): short texts that recur in the top or bottom margin of a source."""
    top, bottom = F.coalesce(F.col("min_y") < c.margin_top, F.lit(False)), F.coalesce(F.col("max_y") > c.page_height - c.margin_bottom, F.lit(False))
    # only blocks that are in a margin count, so only their texts are brought to a form
    inside = blocks.select("source_file", "text", top.alias("top"), bottom.alias("bottom")).where("top or bottom")
    short = inside.select("source_file", T.match_key(F.col("text")).alias("norm"), F.col("top").cast("int").alias("top"), F.col("bottom").cast("int").alias("bottom")).where((F.col("norm") != "") & (T.word_count(F.col("norm")) <= c.repeat_max_words))
    seen = short.groupBy("source_file", "norm").agg(F.sum("top").alias("t"), F.sum("bottom").alias("b"))
    return seen.select("source_file", "norm", (F.col("t") >= c.repeat_threshold).alias("header"), (F.col("b") >= c.repeat_threshold).alias("footer")).where("header or footer")


def with_removal_reason(blocks: DataFrame, c: Cleaning = Cleaning()) -> DataFrame:
    """`blocks` with removal_reason, null for those that stay."""
    found = blocks.withColumn("norm", T.match_key(F.col("text"))).join(repeated_margins(blocks, c), ["source_file", "norm"], "left")
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    reason = P.removal_reason(F.col("_bare"), F.col("max_y"), F.col("doc_item_type"), flag("header"), flag("footer"), c, stripped=True)
    return found.withColumn("_bare", T.strip(F.col("text"))).withColumn("removal_reason", reason).drop("norm", "header", "footer", "_bare")


def filter_noise(blocks: DataFrame, c: Cleaning = Cleaning()) -> tuple[DataFrame, DataFrame]:
    """(kept blocks, blocks by reason)."""
    found = with_removal_reason(blocks, c)
    return found.where("removal_reason is null").drop("removal_reason"), found.groupBy(F.coalesce("removal_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("blocks"))


def toc_pages(blocks: DataFrame, least: int = 5) -> DataFrame:
    """(source_file, page_index) of pages with 'contents' or `least` contents lines."""
    per = blocks.groupBy("source_file", "page_index").agg(F.sum(P.is_toc_line(F.col("text")).cast("int")).alias("lines"), F.max(F.contains(F.lower("text"), F.lit("contents"))).alias("named"))
    return per.where((F.col("lines") >= least) | F.col("named")).select("source_file", "page_index")


def body_font(blocks: DataFrame, default: float = 11.0) -> DataFrame:
    """(source_file, body_font): the median size of blocks of over eight words."""
    return blocks.groupBy("source_file").agg(F.coalesce(F.percentile(F.when((T.word_count(F.col("text")) > 8) & (F.col("max_font_size") > 0), F.col("max_font_size")), F.lit(0.5)), F.lit(default)).alias("body_font"))


def heading_columns(text: Column, font: Column, body: Column, bold: Column, kind: Column, level: Column, min_y: Column, h: Headings = Headings()) -> dict[str, Column]:
    """reason, score, level and is_heading of a block, as columns."""
    bare = T.strip(text)
    n = T.word_count(bare)
    numbered = bare.rlike(r"^\d+(?:\.\d+)*\s+\S")
    ends = bare.rlike(r"[.!?]\z")
    boiler = F.exists(F.array(*map(F.lit, h.boilerplate)), lambda b: F.contains(bare, b)) if h.boilerplate else F.lit(False)
    disqualified = bare.rlike(r"https?://|\.(?:org|com|edu|gov)\b") | bare.rlike(r"^\d+$") | bare.rlike("^[\"'`\\-]+$") | bare.rlike(r"^\s*[•\-*]\s") | boiler
    first = F.regexp_replace(F.lower(F.coalesce(F.get(T.words(bare), F.lit(0)), F.lit(""))), r"[.,;:]+\z", "")
    reason = (
        F.when(n == 0, "empty")
        .when(disqualified, "disqualified_pattern")
        .when(ends & ~F.regexp_replace(bare, r"\.+\z", "").rlike(r"^\d+(?:\.\d+)*\s+\S"), "ends_with_period")
        .when(n > h.max_words, "too_many_words")
        .when(F.contains(bare, F.lit(h.breadcrumb)) & (min_y < h.breadcrumb_max_y), "breadcrumb")
        .when(first.isin(*BODY_STARTS) & (n > 3), "body_starter")
    )
    delta = font - body
    part = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(F.lit(0.0))
    named = (kind == "heading") & (level > 0)
    score = (
        part(named, F.lit(10.0))
        + part((font > 0) & (body > 0) & (delta >= h.min_font_delta), F.least(delta * 1.5, F.lit(8.0)))
        + part(bold & (n <= 10), F.lit(2.0))
        + F.when(numbered & ~boiler, F.lit(5.0)).when(~numbered & bare.rlike(r"(?i)^(?:I{1,3}|IV|VI{0,3}|IX|X{1,3})\.\s+\S"), F.lit(4.0)).otherwise(F.lit(0.0))
        + part((n <= h.caps_max_words) & (T.upper_ratio(bare) >= 0.85), F.lit(4.0))
        + part((n >= 2) & (T.title_words(bare) >= h.title_ratio * n), F.lit(3.0))
        + part((n <= 5) & bare.rlike(r"\A\p{Lu}") & ~ends, F.lit(1.5))
    )
    score = F.when(reason.isNull(), score).otherwise(F.lit(0.0))
    by_font = F.when((font > 0) & (delta >= 10), 1).when((font > 0) & (delta >= 5), 2).when((font > 0) & (delta >= h.min_font_delta), 3)
    depth = F.when(reason.isNotNull(), 0).otherwise(F.coalesce(F.when(named, level), by_font, F.when(score >= 5, F.lit(2)), F.lit(0)))
    return {"heading_reason": reason, "heading_score": score, "level": depth.cast("int"), "is_heading": score >= 4}


def detect_headings(blocks: DataFrame, h: Headings = Headings(), subheadings: tuple[str, ...] = ()) -> DataFrame:
    """`blocks` with heading_reason, heading_score, level, is_heading. `subheadings`: titles that are always of level 3."""
    out = blocks.join(body_font(blocks), "source_file")
    cols = heading_columns(F.col("text"), F.col("max_font_size"), F.col("body_font"), F.col("is_bold"), F.col("doc_item_type"), F.col("heading_level"), F.col("min_y"), h)
    out = out.withColumns(cols)
    if subheadings:
        title = F.regexp_replace(F.lower(T.strip(F.col("text"))), r":+\z", "")
        out = out.withColumn("level", F.when(F.col("is_heading") & title.isin(*subheadings), 3).otherwise(F.col("level")))
    return out.drop("body_font")


def integer_heading_score(text: Column, font: Column, body: Column) -> Column:
    """A whole-number score from -10, a heading from 4 up."""
    n = T.word_count(text)
    part = lambda cond, v: F.when(cond, v).otherwise(0)
    score = part(text.rlike(r"[.!?]\z"), -2) + part(P.is_institution(text), -4) + part(P.is_bullet(text) | P.is_url(text), -4) + part(text.rlike(r"\d{4}") & (n > 4), -2)
    score = score + part(font >= body + 1.5, 4) + part(text.rlike(r"^\d+(?:\.\d+)*\s+"), 3) + part((text == F.upper(text)) & (n <= 8), 2) + part(T.title_words(text) >= F.greatest(F.lit(2), n - 1), 2)
    return F.when((n == 0) | (n > 12), -10).otherwise(score).cast("int")


def is_heading_block(text: Column, font: Column, body: Column) -> Column:
    """By size alone: 1.6 points and 18 % over the body's."""
    n = T.word_count(text)
    return (n > 0) & (n <= 14) & ~text.rlike("[»>]") & ~(text.rlike(r"[.!?]\z") & (font <= body + 1)) & (font >= F.greatest(body + 1.6, body * 1.18)) & ~text.rlike(r"\A[“”\"'`-]+\z")


def carry_levels(lines: DataFrame, by: list[str], seq: str, level: str, title: str, depth: int = 3) -> DataFrame:
    """Adds level1..: the titles in force at each line; a title of a level ends deeper ones."""
    w = W.partitionBy(*by).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    df = lines
    for k in range(1, depth + 1):
        df = df.withColumn(f"_l{k}", F.last(F.when(F.col(level) == k, F.struct(F.col(seq).cast("long").alias("at"), F.col(title).alias("t"))), ignorenulls=True).over(w))
    since, out = F.lit(-1).cast("long"), df
    for k in range(1, depth + 1):
        own = F.when(F.col(f"_l{k}.at") > since, F.col(f"_l{k}"))
        out = out.withColumn(f"level{k}", own["t"])
        since = F.greatest(since, F.coalesce(F.col(f"_l{k}.at"), F.lit(-1).cast("long")))
    return out.drop(*[f"_l{k}" for k in range(1, depth + 1)])


def sections(blocks: DataFrame, drop_preamble: bool = False) -> DataFrame:
    """(source_file, section_id, level, level1..3, heading, content, content_blocks, page_start, page_end).

    A heading opens a section, which takes the blocks up to the next one. Text before a source's first heading
    is section 0, titled like the source, unless dropped. Levels below 1 or over 3 count as 3. Sections without
    text, other than those with no text at all after them, hold none and are left out.
    """
    w = W.partitionBy("source_file").orderBy("page_index", "block_index").rowsBetween(W.unboundedPreceding, 0)
    df = blocks.withColumn("seq", F.row_number().over(W.partitionBy("source_file").orderBy("page_index", "block_index")).cast("long"))
    df = df.withColumn("depth", F.when(F.col("is_heading"), F.when(F.col("level").isin(1, 2), F.col("level")).otherwise(3)))
    df = df.withColumn("section_id", F.sum(F.col("is_heading").cast("long")).over(w))
    df = carry_levels(df, ["source_file"], "seq", "depth", "text")
    one = df.groupBy("source_file", "section_id").agg(
        F.max("depth").alias("level"), *[F.max(f"level{k}").alias(f"level{k}") for k in (1, 2, 3)], F.max(F.when(F.col("is_heading"), F.col("text"))).alias("heading"),
        F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("seq", "text")))), lambda x: x["text"]).alias("content_blocks"),
        F.min("page_index").alias("page_start"), F.max("page_index").alias("page_end"),
    )
    one = one.withColumn("content", F.array_join("content_blocks", "\n"))
    pre = F.col("section_id") == 0
    one = one.withColumn("heading", F.when(pre, F.col("source_file")).otherwise(F.col("heading"))).withColumn("level1", F.when(pre, F.col("source_file")).otherwise(F.col("level1"))).withColumn("level", F.when(pre, 1).otherwise(F.col("level")))
    kept = one.where(F.size("content_blocks") > 0)
    return kept.where("section_id > 0") if drop_preamble else kept


def levels_from_breadcrumb(crumb: Column, heading: Column, depth: int = 3) -> list[Column]:
    """The heading's levels: the breadcrumb's parts, then the heading if it isn't the last of them."""
    parts = F.when(F.coalesce(F.element_at(F.when(F.size(crumb) > 0, crumb), -1) == heading, F.lit(False)), crumb).otherwise(F.concat(F.coalesce(crumb, F.array().cast("array<string>")), F.array(heading)))
    return [F.get(parts, F.lit(k)) for k in range(depth)]


def breadcrumb_for(headings: DataFrame, crumbs: DataFrame) -> DataFrame:
    """For each heading (source_file, page_index, block_index, text) the best breadcrumb before it on its page:
    3 if its last part is the heading, 2 if that holds it, else 1; then the latest."""
    c = crumbs.select("source_file", "page_index", F.col("block_index").alias("crumb_index"), T.breadcrumb(F.col("text"), "»>").alias("crumb"))
    both = headings.join(c, ["source_file", "page_index"]).where("crumb_index <= block_index")
    last = F.lower(F.element_at("crumb", -1))
    score = F.when(last == F.lower("text"), 3).when(F.contains(last, F.lower("text")), 2).otherwise(1)
    best = F.row_number().over(W.partitionBy("source_file", "page_index", "block_index").orderBy(score.desc(), F.col("crumb_index").desc()))
    return both.withColumn("score", score).withColumn("rn", best).where("rn = 1").drop("rn")


def between_anchors(blocks: DataFrame, anchor: Column) -> DataFrame:
    """(source_file, anchor_seq, anchor_text, content): the text after each anchor block, up to the next one."""
    w = W.partitionBy("source_file").orderBy("page_index", "block_index")
    df = blocks.withColumn("seq", F.row_number().over(w)).withColumn("at", F.last(F.when(anchor, F.struct("seq", "text")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).where("at is not null")
    return df.groupBy("source_file", F.col("at.seq").alias("anchor_seq")).agg(F.max("at.text").alias("anchor_text"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("seq") != F.col("at.seq"), F.struct("seq", "text")))), lambda x: x["text"]), " ").alias("content"))


def tree(chunks: DataFrame) -> DataFrame:
    """(level1, level2, level3, chunk_ids): the hierarchy's leaves with their chunks; absent levels read '(none)'."""
    none = lambda n: F.coalesce(F.col(n), F.lit("(none)")).alias(n)
    return chunks.select(none("level1"), none("level2"), none("level3"), "chunk_id").groupBy("level1", "level2", "level3").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))

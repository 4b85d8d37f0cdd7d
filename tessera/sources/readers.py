"""Sources: files to blocks, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions import text as T
from tessera.operators import layout

BLOCKS = "source_file STRING, parser STRING, page_index INT, block_index INT, text STRING, doc_item_type STRING, heading_level INT, max_font_size DOUBLE, is_bold BOOLEAN, bbox ARRAY<DOUBLE>"
CHUNKS = "chunk_id STRING, source_file STRING, level1 STRING, level2 STRING, level3 STRING, heading STRING, content STRING, page_start INT, page_end INT, token_count INT"
#: Where a record's text and heading may be, in order.
TEXT_KEYS = ("cleaned_text", "content", "text", "body", "value")
HEADING_KEYS = ("heading", "title", "metadata.heading")


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, content) of binary files, by name; the listing is Spark's own."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "modificationTime", "length", "content")


def listing(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    return files(spark, path, glob).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "length").orderBy("source_file")


def format_of(path: str, given: str | None = None) -> str:
    """'pdf', 'txt', 'md', 'json' or 'jsonl', by suffix unless given."""
    kind = given or path.rsplit(".", 1)[-1].lower()
    if kind not in ("pdf", "txt", "md", "json", "jsonl"):
        raise ValueError(f"no reader for {kind!r}")
    return kind


def parsed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks written as JSON lines; absent fields get their defaults."""
    df = spark.read.schema(BLOCKS).json(path)
    at = lambda i, v: F.coalesce(F.get("bbox", F.lit(i)), F.lit(v))
    return df.select(
        F.coalesce("source_file", F.lit("unknown")).alias("source_file"), F.coalesce("parser", F.lit("")).alias("parser"), F.coalesce("page_index", F.lit(0)).alias("page_index"), F.coalesce("block_index", F.lit(0)).alias("block_index"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_item_type", F.lit("text")).alias("doc_item_type"), F.coalesce("heading_level", F.lit(0)).alias("heading_level"), F.coalesce("max_font_size", F.lit(0.0)).alias("max_font_size"), F.coalesce("is_bold", F.lit(False)).alias("is_bold"),
        at(0, 0.0).alias("min_x"), at(1, 0.0).alias("min_y"), at(2, 0.0).alias("max_x"), at(3, 0.0).alias("max_y"),
    )


def chunk_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Chunks of JSON lines: ids as strings, blank lines skipped. strict: a broken line is an error, else it is left out."""
    df = spark.read.schema(CHUNKS).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.where("chunk_id IS NOT NULL OR content IS NOT NULL").withColumn("chunk_key", F.sha2(F.concat_ws("\x1f", F.coalesce("source_file", F.lit("")), F.coalesce("chunk_id", F.lit(""))), 256))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(heading, content, ..): JSON of one object, a list, or an object with `sections`; text from the first filled key."""
    df = spark.read.option("multiLine", True).json(path)
    if "sections" in df.columns:
        df = df.select(F.explode_outer("sections").alias("s")).select("s.*")
    has = lambda c: c in df.columns or ("." in c and c.split(".")[0] in df.columns)
    first = lambda keys: P.first_filled(*[k for k in keys if has(k)]) if any(map(has, keys)) else F.lit(None).cast("string")
    keep = [c for c in ("level1", "level2", "level3", "level4", "source_file") if c in df.columns]
    return df.select(*keep, first(HEADING_KEYS).alias("heading"), first(TEXT_KEYS).alias("content"))


def text_sections(docs: DataFrame, source: str = "source_file", text: str = "text") -> DataFrame:
    """(source_file, section, heading, content): paragraphs under the heading-like ones before them."""
    p = docs.select(F.col(source).alias("source_file"), F.posexplode(T.paragraphs(F.coalesce(F.col(text), F.lit("")))).alias("seq", "p")).withColumn("is_heading", P.is_heading_like(F.col("p")))
    w = W.partitionBy("source_file").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("section", F.sum(F.col("is_heading").cast("long")).over(w))
    out = p.groupBy("source_file", "section").agg(F.max(F.when(F.col("is_heading"), F.regexp_replace("p", r"^#+\s*", ""))).alias("heading"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("seq", "p")))), lambda x: x["p"]), "\n\n").alias("content"))
    return out.where("content <> ''")


def marked_sections(lines: DataFrame, by: str = "source_file", seq: str = "seq", line: str = "line") -> DataFrame:
    """(by, section, level1..3, content) of lines with `=== LEVELn: title ===` marks; a level's mark ends deeper ones."""
    mark = r"^===\s*LEVEL([123]):\s*(.*?)\s*===\s*$"
    df = lines.withColumn("level", F.regexp_extract(line, mark, 1)).withColumn("level", F.when(F.col("level") != "", F.col("level").cast("int"))).withColumn("title", F.regexp_extract(line, mark, 2))
    df = layout.carry_levels(df, [by], seq, "level", "title")
    w = W.partitionBy(by).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("section", F.count("level").over(w))
    out = df.groupBy(by, "section").agg(*[F.max(f"level{k}").alias(f"level{k}") for k in (1, 2, 3)], F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("level").isNull(), F.struct(F.col(seq).alias("s"), F.col(line).alias("l"))))), lambda x: x["l"]), "\n").alias("content"))
    return out.withColumn("content", T.clean_section(F.col("content"))).where("section > 0 and content <> ''")


def heading_list(line: Column) -> tuple[Column, Column]:
    """(level, title) of lines such as `Level 2: title`."""
    pattern = r"(?i)^\s*level\s*(\d+)\s*:\s*(.+?)\s*$"
    n = F.regexp_extract(line, pattern, 1)
    return F.when(n != "", n.cast("int")), F.when(n != "", F.regexp_extract(line, pattern, 2))


def page_windows(pages: DataFrame, size: int = 200, least: int = 15) -> DataFrame:
    """(source_file, page_index, chunk_id, heading, content) of page texts: windows of words, short pages left out; the
    heading is the page's first line if that has up to eight words."""
    w = pages.withColumn("w", T.words(F.col("text"))).where(F.size("w") >= least)
    first = F.get(F.filter(F.split("text", "\n"), lambda x: T.strip(x) != ""), F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / size).cast("int") - 1), lambda i: F.array_join(F.slice("w", i * size + 1, size), " "))
    out = w.select("source_file", "page_index", F.when(T.word_count(first) <= 8, T.strip(first)).otherwise(F.lit("")).alias("heading"), F.posexplode(parts).alias("n", "content"))
    return out.withColumn("chunk_id", F.concat_ws("_", F.lit("chunk"), F.col("page_index").cast("string"), F.col("n").cast("string"))).drop("n")


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, seq, tag, text): headings, paragraphs and list items of web pages in order (an extension)."""
    flat = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style|nav|footer)\b.*?</\1>", " ")
    found = F.regexp_extract_all(flat, F.lit(r"(?is)(<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)>)"), F.lit(1))
    df = pages.select(F.col(key), F.posexplode(found).alias("seq", "raw"))
    body = F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " ")
    return df.select(key, F.col("seq").cast("long").alias("seq"), F.lower(F.regexp_extract("raw", r"(?i)^<(h[1-6]|p|li)", 1)).alias("tag"), F.trim(body).alias("text"))

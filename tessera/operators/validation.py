"""Quality of headings and chunks: scores from 100 down, issues with code and severity, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import Validation
from tessera.functions import text as T

ISSUE = "array<struct<code:string,severity:string>>"


def _judged(rules: list[tuple[str, str, Column, Column]], empty: tuple[str, Column]) -> tuple[Column, Column]:
    """(score, issues) of (code, severity, condition, loss) rules; an empty text scores 0 by the one rule."""
    code, is_empty = empty
    score = F.lit(100.0)
    for _, _, cond, loss in rules:
        score = score - F.when(cond, loss).otherwise(F.lit(0.0))
    found = F.filter(F.array(*[F.when(cond, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s, cond, _ in rules]), lambda x: x.isNotNull())
    alone = F.array(F.struct(F.lit(code).alias("code"), F.lit("error").alias("severity")))
    return F.when(is_empty, F.lit(0.0)).otherwise(F.greatest(score, F.lit(0.0))), F.when(is_empty, alone).otherwise(found)


def heading_quality(heading: Column, v: Validation = Validation(), n: Column | None = None) -> tuple[Column, Column]:
    """n: the words, if they are known; the heading is then stripped already."""
    h = T.strip(F.coalesce(heading, F.lit(""))) if n is None else heading
    n, loss = T.word_count(h) if n is None else n, lambda x: F.lit(float(x))
    lower = (h == F.lower(h)) & h.rlike(r"\p{L}") & (n > 1)
    symbols = F.regexp_count(h, F.lit(r"(?U)[^\w\s]")) / F.greatest(F.length(h), F.lit(1))
    rules = [("H002", "warning", n < v.heading_min_words, loss(30)), ("H003", "warning", n > v.heading_max_words, loss(20)), ("H004", "warning", lower, loss(20))]
    rules += [("H005", "error", h.rlike(p), loss(50)) for p in v.bad_headings]
    rules += [("H006", "warning", symbols > v.heading_max_symbols, loss(20)), ("H007", "warning", h.rlike(r"(?:and|or|the|of|with)\z"), loss(30))]
    return _judged(rules, ("H001", h == ""))


def content_quality(content: Column, v: Validation = Validation(), n: Column | None = None) -> tuple[Column, Column]:
    """n: the words, if they are known; the content is then stripped already."""
    c = T.strip(F.coalesce(content, F.lit(""))) if n is None else content
    n, size, loss = T.word_count(c) if n is None else n, F.greatest(F.length(c), F.lit(1)), lambda x: F.lit(float(x))
    merges = F.regexp_count(c, F.lit("[a-z][A-Z][a-z]"))
    rules = [
        ("C002", "warning", n < v.content_min_words, loss(40)),
        ("C003", "warning", n > v.content_max_words, loss(10)),
        ("C004", "warning", merges > 0, F.least(merges * 10, F.lit(50)).cast("double")),
        ("C005", "warning", F.regexp_count(c, F.lit(r"\p{L}")) / size < v.content_min_alpha, loss(30)),
        ("C006", "warning", F.regexp_count(c, F.lit("[.!?,;:]")) / size < v.content_min_punctuation, loss(20)),
        ("C007", "warning", F.regexp_count(c, F.lit("\n")) > v.content_max_newlines * n, loss(20)),
    ]
    return _judged(rules, ("C001", c == ""))


def semantic_quality(similarity: Column, v: Validation = Validation()) -> tuple[Column, Column]:
    """From the cosine of heading and content; its double loss below half of the least."""
    low = similarity < v.semantic_min
    score = F.greatest(similarity * 100 - F.when(similarity < v.semantic_min / 2, 30.0).otherwise(0.0), F.lit(0.0))
    return score, F.when(low, F.array(F.struct(F.lit("S001").alias("code"), F.lit("warning").alias("severity")))).otherwise(F.array().cast(ISSUE))


def hierarchy_issues(level1: Column, level2: Column, level3: Column) -> Column:
    """H008: level 3 without 2; H009: level 2 without 1."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    one = lambda code, cond: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit("warning").alias("severity")))
    return F.filter(F.array(one("H008", has(level3) & ~has(level2)), one("H009", has(level2) & ~has(level1))), lambda x: x.isNotNull())


def validate(chunks: DataFrame, similarity: Column | None = None, v: Validation = Validation()) -> DataFrame:
    """`chunks` (heading, content, level1..3) with quality<heading, content, semantic, overall> and issues."""
    # stripped texts and their words are columns, so that the rules don't make them anew each
    bare = chunks.withColumns({f"_{c}": T.strip(F.coalesce(c, F.lit(""))) for c in ("heading", "content")})
    bare = bare.withColumns({f"_{c}_n": T.word_count(F.col(f"_{c}")) for c in ("heading", "content")})
    hs, hi = heading_quality(F.col("_heading"), v, F.col("_heading_n"))
    cs, ci = content_quality(F.col("_content"), v, F.col("_content_n"))
    ss, si = semantic_quality(F.lit(1.0) if similarity is None else similarity, v)
    df = bare.withColumns({"_h": hs, "_c": cs, "_s": ss, "issues": F.concat(hi, ci, si, hierarchy_issues(F.col("level1"), F.col("level2"), F.col("level3")))})
    w = v.weights
    overall = w[0] * F.col("_h") + w[1] * F.col("_c") + w[2] * F.col("_s")
    return df.withColumn("quality", F.struct(F.col("_h").alias("heading"), F.col("_c").alias("content"), F.col("_s").alias("semantic"), overall.alias("overall"))).drop("_h", "_c", "_s", "_heading", "_content", "_heading_n", "_content_n")


def summary(judged: DataFrame, v: Validation = Validation()) -> DataFrame:
    """One row: chunks, mean, least and best score, flagged, critical, mean and range of words."""
    score, n = F.col("quality.overall"), T.word_count(F.coalesce(F.col("content"), F.lit("")))
    return judged.agg(
        F.count("*").alias("chunks"), F.avg(score).alias("avg_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        F.count_if((score < v.flag_below) | (F.size("issues") > 0)).alias("flagged"), F.count_if(F.exists("issues", lambda x: x["severity"] == "error")).alias("critical"),
        F.avg(n).alias("avg_words"), F.min(n).cast("long").alias("min_words"), F.max(n).cast("long").alias("max_words"),
    )


def issue_counts(judged: DataFrame) -> DataFrame:
    return judged.select(F.explode("issues").alias("i")).groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


def worst(judged: DataFrame, n: int = 10, key: str = "chunk_id", v: Validation = Validation()) -> DataFrame:
    return judged.where(F.col("quality.overall") < v.flag_below).orderBy("quality.overall", key).limit(n)


def issue_report(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(issue, n, percent, examples): six plain rules, with the five smallest keys of each."""
    c, n = F.coalesce(F.col("content"), F.lit("")), T.word_count(F.coalesce(F.col("content"), F.lit("")))
    blank = lambda x: T.strip(F.coalesce(F.col(x), F.lit(""))) == ""
    rules = {"Too short": n < 40, "Too long": n > 800, "Empty heading": blank("heading"), "Missing level1": blank("level1"), "Starts lowercase": c.rlike(r"\A\p{Ll}"), "OCR merge": c.rlike("[a-z][A-Z][a-z]")}
    hits = chunks.select(F.col(key).alias("k"), F.explode(F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())).alias("issue"))
    per = hits.groupBy("issue").agg(F.count("*").alias("n"))
    few = hits.groupBy("issue", "k").agg(F.lit(1).alias("one")).withColumn("rn", F.row_number().over(W.partitionBy("issue").orderBy("k"))).where("rn <= 5").groupBy("issue").agg(F.sort_array(F.collect_list("k")).alias("examples"))
    total = chunks.agg(F.count("*").alias("total"))
    return per.join(few, "issue").crossJoin(F.broadcast(total)).select("issue", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"), "examples")


def word_histogram(texts: DataFrame, text: str = "content") -> DataFrame:
    """(bucket, n): six ranges of words."""
    n = T.word_count(F.coalesce(F.col(text), F.lit("")))
    bucket = F.when(n < 50, "0-49").when(n < 100, "50-99").when(n < 200, "100-199").when(n < 400, "200-399").when(n < 800, "400-799").otherwise("800+")
    return texts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def source_audit(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_file, status, total_chunks, matched_chunks, match_percentage): chunks whose text, white space aside, is in
    their source's. `sources`: source_file, text. Our own definition; a chunk meets its own source only."""
    flat = lambda c: T.strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    both = chunks.join(sources.select("source_file", flat(F.col("text")).alias("whole")), "source_file", "left")
    per = both.groupBy("source_file").agg(F.count("*").alias("total_chunks"), F.count_if(F.contains("whole", flat(F.col("content")))).alias("matched_chunks"))
    return per.withColumn("match_percentage", F.round(100.0 * F.col("matched_chunks") / F.col("total_chunks"), 2)).withColumn("status", F.when(F.col("matched_chunks") == F.col("total_chunks"), "complete").when(F.col("matched_chunks") == 0, "missing").otherwise("partial"))

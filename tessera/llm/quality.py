"""Line-first quality rules [native]: judge every line, drop the failing ones, reject documents that lose too much.

Only DataFrame functions run here. Counts follow whole texts; nothing is shuffled.
A null text is an empty one: no words, no lines, rejected by the base rule. Very long texts are one
row each and cost in proportion to their length. Repeated rows are judged apart and alike. An empty table
gives no rows. Other columns are carried along, whatever their names; only an input column of the same name as
one that is added (`ADDED`) is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, WORD, without

SYMBOLS = "#*$%&|<>"
#: Java patterns, tried on one line each.
NAVIGATION = r"(?i)^\s*(?:home|menu|skip to (?:main )?content|sign in|log ?in|sign up|subscribe|next(?: page)?|previous(?: page)?|back to top|share this|read more|click here|search|sitemap|contact us|about us)\s*[.!:>»|]*\s*$"
BOILERPLATE = r"(?i)\ball rights reserved\b|\bterms of (?:use|service)\b|\bprivacy policy\b|\bcookies? (?:policy|settings)\b|\benable javascript\b|\blorem ipsum\b"


ADDED = ("q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "q_base_failed", "q_lost_words", "q_text", "q_kept")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of what a document may lose.

    symbol_share: symbols by characters of a line that aren't blank; bars: column bars of a line that make it
    a navigation or table row; shout_share: words ending in '!!' by words; lost_share: words of failing lines
    by words of the document, above which it is rejected.
    """

    window: int = 8
    min_words: int = 20
    repeat_percent: int = 30
    symbol_share: float = 0.08
    bars: int = 3
    shout_share: float = 0.2
    min_line_words: int = 8
    lost_share: float = 0.5


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """Why a line fails: 'symbols', 'navigation', 'shouting', 'boilerplate', 'punctuation', else null.

    Punctuation: a line of at least `min_line_words` words with no sentence mark anywhere in it. Shorter
    lines without one are titles or the rest of a wrapped sentence and stay.
    """
    solid = F.length(without(line, BLANKS))
    symbols = solid - F.length(without(without(line, BLANKS), SYMBOLS))
    words = F.regexp_count(line, F.lit(WORD))
    return (
        F.when(F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= rules.bars, F.lit("navigation"))
        .when(symbols > rules.symbol_share * solid, F.lit("symbols"))
        .when(F.regexp_count(line, F.lit(r"!!(?=[\x20\x09-\x0D]|$)")) > rules.shout_share * words, F.lit("shouting"))
        .when(line.rlike(NAVIGATION), F.lit("navigation"))
        .when(line.rlike(BOILERPLATE), F.lit("boilerplate"))
        .when((words >= rules.min_line_words) & ~line.rlike(r"[.!?;:…。！？]"), F.lit("punctuation"))
    )


def judge(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Adds q_words, q_word_chars, q_symbols, q_dup_lines, q_repeat_words, q_base_failed, q_lost_words, q_text, q_kept.

    q_text is the text without its failing lines. Windows of words count as equal when their 64-bit hashes are.
    """
    raw, k = F.coalesce(F.col(f"`{text}`"), F.lit("")), rules.window
    kept = {f"c{i}": c for i, c in enumerate(docs.columns) if c not in ADDED}  # inside, input columns have names of their own
    df = docs.select(*[F.col(f"`{c}`").alias(i) for i, c in kept.items()], raw.alias("q_raw"))
    solid = without(F.col("q_raw"), BLANKS)
    df = df.select(
        "*",
        F.regexp_extract_all("q_raw", F.lit(WORD), F.lit(0)).alias("q_w"),
        F.length(solid).cast("long").alias("q_word_chars"),
        (F.length("q_raw") - F.length(without(F.col("q_raw"), SYMBOLS))).cast("long").alias("q_symbols"),
        F.split("q_raw", "\n", -1).alias("q_all_lines"),
    )
    df = df.select(
        "*",
        F.size("q_w").cast("long").alias("q_words"),
        F.filter("q_all_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("q_lines"),
        F.when(F.size("q_w") > k, F.transform(F.sequence(F.lit(1), F.size("q_w") - (k - 1)), lambda i: F.xxhash64(F.slice("q_w", i, k)))).otherwise(F.array().cast("array<bigint>")).alias("q_h"),
        F.transform("q_all_lines", lambda x: F.struct(x.alias("t"), line_fails(x, rules).alias("why"))).alias("q_judged"),
    ).drop("q_w", "q_all_lines")
    # only texts with a window twice pay for the sort
    df = df.select(
        "*",
        F.when(F.size(F.array_distinct("q_h")) < F.size("q_h"), F.sort_array(F.transform("q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("q_sorted"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_dup_lines"),
        F.filter("q_judged", lambda x: x["why"].isNotNull()).alias("q_failed"),
        F.array_join(F.transform(F.filter("q_judged", lambda x: x["why"].isNull()), lambda x: x["t"]), "\n").alias("q_text"),
    ).drop("q_h", "q_lines", "q_judged")
    same = lambda a, b: F.coalesce(F.get("q_sorted", a)["h"] == b["h"], F.lit(False))
    df = df.select("*", F.sort_array(F.transform(F.filter("q_sorted", lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"])).alias("q_at")).drop("q_sorted")
    df = df.select(
        "*",
        F.coalesce(F.aggregate(F.transform("q_at", lambda p, j: F.when(j == 0, F.lit(k)).otherwise(F.least(F.lit(k), p - F.get("q_at", j - 1)))), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("q_repeat_words"),
        F.aggregate(F.transform("q_failed", lambda x: F.regexp_count(x["t"], F.lit(WORD))), F.lit(0).cast("long"), lambda a, x: a + x).alias("q_lost_words"),
    ).drop("q_at", "q_failed")
    failed = (F.col("q_words") < rules.min_words) | (100 * F.col("q_repeat_words") > rules.repeat_percent * F.col("q_words"))
    df = df.select("*", failed.alias("q_base_failed"))
    return df.select("*", (~F.col("q_base_failed") & (F.col("q_lost_words") <= rules.lost_share * F.col("q_words"))).alias("q_kept")).select(*[F.col(i).alias(c) for i, c in kept.items()], *ADDED)


def clean(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The kept documents, with the cleaned text in place of `text` and the columns of `docs`.

    The row number keeps the optimizer from moving the filter below the projections, where every
    reference to a column would compute it again.
    """
    names = docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    judged = judge(numbered, rules, f"c{names.index(text)}").withColumn("q_row", F.monotonically_increasing_id())
    return judged.where((F.col("q_row") >= 0) & F.col("q_kept")).select(*[F.col("q_text" if c == text else f"c{i}").alias(c) for i, c in enumerate(names)])

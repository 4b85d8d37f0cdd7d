"""Sections into chunks: fixed windows, sentence packing, semantic splitting, repair and stitching."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructType

from tessera.config import Chunking, Repair
from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.shared import small_batches

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = frozenset("appt approx avg bx dept dr dx e.g etc fig fx hx i.e inc jr max mg min ml mr mrs ms no oz prof pt rx sr st sx tx vol vs".split())

_BULLET = re.compile(r"^\s*[-*•●◦▪▸►‣⁃]\s|^\s*\d+[.)]\s|^\s*[a-zA-Z][.)]\s")
_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'(])")


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 200) -> DataFrame:
    """(key, window, content, word_count): consecutive runs of `size` words, the last one shorter."""
    w = docs.select(F.col(key), T.words(F.coalesce(F.col(text), F.lit(""))).alias("w")).where(F.size("w") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / size).cast("int") - 1), lambda i: F.slice("w", i * size + 1, size))
    return w.select(key, F.posexplode(parts).alias("window", "part")).select(key, F.col("window").cast("long").alias("window"), F.array_join("part", " ").alias("content"), F.size("part").cast("long").alias("word_count"))


def linked(chunks: DataFrame, by: str, seq: str, key: str = "chunk_id") -> DataFrame:
    """Adds chunk_index, prev_chunk_id and next_chunk_id along each document."""
    w = W.partitionBy(by).orderBy(seq)
    return chunks.withColumn("chunk_index", F.row_number().over(w).cast("long")).withColumn("prev_chunk_id", F.lag(key).over(w)).withColumn("next_chunk_id", F.lead(key).over(w))


def split_sentences(text: str | None) -> list[str]:
    """Sentences of a text; bullets are their own; a listed abbreviation's full stop ends none."""
    out: list[str] = []

    def plain(lines: list[str]) -> None:
        fresh = len(out)
        for part in filter(None, map(str.strip, _END.split(" ".join(lines)))):
            last = out[-1].lower().split()[-1].rstrip(".") if len(out) > fresh else None
            if last in ABBREVIATIONS:
                out[-1] = f"{out[-1]} {part}"
            else:
                out.append(part)

    held: list[str] = []
    for line in filter(None, map(str.strip, (text or "").split("\n"))):
        if _BULLET.match(line):
            plain(held)
            held = []
            out.append(line)
        else:
            held.append(line)
    plain(held)
    return out


@F.pandas_udf(ArrayType(StringType()))
def sentences(text: pd.Series) -> pd.Series:
    return text.map(split_sentences)


def is_good_break(current: Column, following: Column) -> Column:
    """The one ends a sentence and the other leans on nothing before it."""
    first = F.regexp_replace(F.lower(F.coalesce(F.get(T.words(following), F.lit(0)), F.lit(""))), r"[.,;:]+\z", "")
    return T.strip(current).rlike(r"[.!?]\z") & ~first.isin(*K.PRONOUNS, *K.TRANSITIONS)


def _good(current: str, following: str) -> bool:
    first = (following.split() or [""])[0].lower().rstrip(".,;:")
    return current.rstrip().endswith((".", "!", "?")) and first not in K.PRONOUNS and first not in K.TRANSITIONS


def pack(parts: list[str], c: Chunking = Chunking()) -> list[str]:
    """Sentences into chunks: cut before `max_words`, from `target_words` on at a good break; the next chunk repeats the
    last `overlap_sentences`; an end of under `tiny_words` joins the chunk before it."""
    out: list[str] = []
    held: list[str] = []
    size = 0

    def emit() -> None:
        nonlocal held, size
        out.append(" ".join(held))
        held = held[len(held) - c.overlap_sentences :] if c.overlap_sentences else []
        size = sum(len(s.split()) for s in held)

    for i, s in enumerate(parts):
        n = len(s.split())
        if held and size + n > c.max_words:
            emit()
        held.append(s)
        size += n
        if size >= c.target_words and i + 1 < len(parts) and _good(s, parts[i + 1]):
            emit()
    if held:
        rest = " ".join(held)
        if out and len(rest.split()) < c.tiny_words:
            out[-1] += "\n\n" + rest
        else:
            out.append(rest)
    return out


def packed(sections: DataFrame, c: Chunking = Chunking(), content: str = "content") -> DataFrame:
    """`sections` with content replaced by their chunks' and `part` (from 0); a section of up to `max_words` is one chunk."""

    @F.pandas_udf(ArrayType(StringType()))
    def chunks(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [] if not (t or "").strip() else [t] if len(t.split()) <= c.max_words else pack(split_sentences(t), c))

    keep = [x for x in sections.columns if x != content]
    return sections.select(*keep, F.posexplode(chunks(F.col(content))).alias("part", content)).withColumn("word_count", T.word_count(F.col(content)))


def _terms(text: str) -> set[str]:
    stem = lambda t: t[:-3] + "y" if len(t) > 4 and t.endswith("ies") else t[:-1] if len(t) > 4 and t.endswith("s") and not t.endswith("ss") else t
    return {x for x in map(stem, re.findall(r"[a-z0-9]+", text.lower())) if x not in K.STOP_WORDS}


def _awkward(text: str) -> bool:
    m = re.search(r"[A-Za-z']+", text)
    first, bare = (m.group().lower() if m else ""), text.lstrip('("“')
    return not text or first in K.OPENERS or bare[:1].islower() or (first in K.LIGHT_PRONOUNS and len(text.split()) <= 12)


def semantic_ranges(units: list[tuple[str, int]], least: int = 80, target: int = 180, most: int = 300, overlap: int = 1, c: Chunking = Chunking()) -> list[tuple[int, int]]:
    """[start, end) of chunks over (sentence, paragraph) units.

    Past `least` words a chunk ends before `most`; past `target` at a new paragraph or where the next sentence
    shares under 8 % of its terms with the last three; past `least` where both hold weakly and the target would be
    reached. A chunk starts `overlap` sentences back, moved on past awkward starts, and loses an awkward head
    as long as `least` words stay.
    """
    words, n = [len(t.split()) for t, _ in units], len(units)
    upto = [0, *accumulate(words)]
    terms = cache(lambda i: frozenset(_terms(units[i][0])))  # only those near a possible end are asked for

    def split(start: int, end: int) -> bool:
        size = upto[end] - upto[start]
        if size < least:
            return False
        then = upto[end + 1] - upto[start]
        if then > most:
            return True
        fresh = units[end][1] != units[end - 1][1]
        if size >= target and fresh:
            return True
        if size < target and not (fresh and then >= target):
            return False
        near, new = frozenset().union(*map(terms, range(max(start, end - 3), end))), terms(end)
        alike = len(near & new) / len(near | new) if near and new else 0.0
        return alike < (c.apart if size >= target else c.weakly_apart)

    out, start = [], 0
    while start < n:
        end = next((e for e in range(start + 1, n) if split(start, e)), n)
        out.append((start, end))
        if end >= n:
            break
        at = end if overlap <= 0 else max(start + 1, end - overlap)
        while overlap > 0 and at < end - 1 and _awkward(units[at][0]):
            at += 1
        start = at
    return [(next((s for s in range(a, b) if s == b - 1 or not _awkward(units[s][0]) or upto[b] - upto[s + 1] < least), a), b) for a, b in out]


def semantic_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 80, target: int = 180, most: int = 300, overlap: int = 1) -> DataFrame:
    """(key, part, content, word_count, sentence_count): documents split by meaning, lines counting as paragraphs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f["key"], f["text"], strict=True):
                units = [(s, p) for p, line in enumerate((t or "").split("\n")) for s in split_sentences(line) if not (len(s.split()) <= 5 and re.fullmatch(r"[a-z][a-z,\s-]*[.,;:!?]?", s))]
                for i, (a, b) in enumerate(semantic_ranges(units, least, target, most, overlap)):
                    content = "".join(u if j == a else ("\n\n" if p != units[j - 1][1] else " ") + u for j, (u, p) in enumerate(units[a:b], a))
                    rows.append((k, i, content, len(content.split()), b - a))
            yield pd.DataFrame(rows, columns=["key", "part", "content", "word_count", "sentence_count"])

    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, part long, content string, word_count long, sentence_count long")
    return got.withColumnRenamed("key", key)


def split_report(chunks: DataFrame, most: int = 300) -> DataFrame:
    """Counts of odd chunks in one row."""
    c = F.col("content")
    bad = {"empty": T.strip(c) == "", "no_end": ~T.strip(c).rlike(r"[.!?\"')]\z"), "lower_start": K.starts_lower(c), "transition_start": K.is_transition(c), "oversized": T.word_count(c) > 1.35 * most}
    return chunks.agg(F.count("*").alias("chunks"), *[F.count_if(v).alias(k) for k, v in bad.items()])


def learn_boilerplate(chunks: DataFrame, r: Repair = Repair(), key: str = "source_file") -> DataFrame:
    """(line, n): first and last lines that recur on a share of pages, of over eight characters."""
    lines = chunks.select(F.coalesce("page_start", F.lit(0)).alias("page"), F.filter(F.transform(F.split("content", "\n"), T.strip), lambda x: x != "").alias("l")).where(F.size("l") > 0)
    ends = lines.select(F.explode(F.array(F.element_at("l", 1), F.element_at("l", -1))).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    pages = chunks.agg(F.count_distinct(F.coalesce("page_start", F.lit(0))).alias("pages"))
    found = ends.crossJoin(pages).where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * r.min_frequency))).select("line", "n")
    if r.seeds:
        found = found.unionByName(chunks.sparkSession.createDataFrame([(s, 0) for s in r.seeds], "line string, n long"))
    return found.where(F.length("line") > 8)


def strip_boilerplate(chunks: DataFrame, patterns: DataFrame, keys: list[str], r: Repair = Repair(), salts: int = 64) -> DataFrame:
    """`chunks` without lines that are nearly a pattern; a chunk that would be empty keeps its longest line.

    Only distinct lines meet the patterns, and only those whose length could reach the ratio: a line shares its
    length's step with a pattern or a neighbour's, which makes it a join on that step.
    """
    lines = chunks.select(*keys, F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("bare", T.strip(F.col("line")))
    step = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / 0.25).cast("int")
    distinct = lines.select("bare").where("bare <> ''").distinct().withColumn("step", step("bare"))
    near = patterns.select("line", F.explode(F.array(step("line") - 1, step("line"), step("line") + 1)).alias("step"))
    # there are few steps: lines are dealt over `salts` parts of each, and patterns go to all of these
    distinct = distinct.withColumn("salt", F.pmod(F.xxhash64("bare"), F.lit(salts)).cast("int"))
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    bad = distinct.join(near, ["step", "salt"]).where(T.fuzzy_ratio(F.col("bare"), F.col("line")) >= r.fuzzy).select("bare").distinct().withColumn("bad", F.lit(True))
    marked = lines.join(bad, "bare", "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "line", F.coalesce("bad", F.lit(False)).alias("bad")))).alias("l"))
    kept = F.transform(F.filter("l", lambda x: ~x["bad"]), lambda x: x["line"])
    longest = F.array_max(F.transform("l", lambda x: F.struct(F.length(x["line"]).alias("n"), (-x["pos"]).alias("p"), x["line"].alias("line"))))["line"]
    return chunks.drop("content").join(marked.select(*keys, F.when(T.strip(F.array_join(kept, "\n")) == "", longest).otherwise(F.array_join(kept, "\n")).alias("content")), keys)


# Words that leave a heading open at its end.
DANGLING = ("and", "are", "at", "for", "is", "of", "the", "to", "with")


def is_broken_heading(heading: Column, content: Column, starters: tuple[str, ...] = ()) -> Column:
    h, n = T.strip(F.coalesce(heading, F.lit(""))), T.word_count(F.coalesce(heading, F.lit("")))
    known = F.exists(F.array(*map(F.lit, starters)), lambda s: F.startswith(F.lower(h), F.lower(s))) & (n < 5) if starters else F.lit(False)
    return (h == "") | F.lower(h).rlike(rf"(?:{'|'.join(DANGLING)})\z") | ((n < 2) & ~h.rlike(r"\A\d")) | known | T.strip(content).rlike(r"\A\p{Ll}")


def healed(heading: Column, content: Column, r: Repair = Repair()) -> tuple[Column, Column]:
    """(heading, content): a fragment takes the content's first line if that makes up to 15 words."""
    h, t = T.strip(F.coalesce(heading, F.lit(""))), T.strip(F.coalesce(content, F.lit("")))
    first = F.get(F.filter(F.split(t, "\n"), lambda x: T.strip(x) != ""), F.lit(0))
    whole = T.strip(F.concat_ws(" ", h, first))
    ok = F.coalesce((F.lower(h).rlike(rf"(?:{'|'.join(DANGLING)})\z") | (T.word_count(h) < 4)) & ~h.rlike(r"[.!?]\z") & (T.word_count(whole) <= r.max_heading_words) & (t != ""), F.lit(False))
    at = F.position(first, t)
    rest = T.strip(F.concat(F.left(t, at - 1), F.substr(t, at + F.length(first))))
    return F.when(ok, whole).otherwise(h), F.when(ok, rest).otherwise(t)


STITCHED = "source_file string, chunk_id long, level1 string, level2 string, level3 string, heading string, content string, page_start int, page_end int, word_count long, repair_actions array<string>"


def _folded(chunks: DataFrame, step: Callable[[dict | None, dict], bool], schema: str, close: Callable[[dict, int], dict], held: int = 1 << 22) -> DataFrame:
    """Each source's chunks in order of chunk_id, of which step(a, row) puts a row into the chunk `a` before it, or says that it is one of its own.

    close(a, n) ends the n-th chunk of a source. Sources are dealt over tasks and sorted there, and a worker reads on from row to
    row: it holds the chunk that may go on and about `held` characters of ended ones, however many sources there are or how long they are.
    """
    names = [f.name for f in chunks.schema]
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, out, size = None, 0, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for values in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    row = dict(zip(names, values, strict=True))
                    same = last is not None and last["source_file"] == row["source_file"]
                    if same and step(last, row):
                        continue
                    if last is not None:
                        out.append(close(last, n))
                        size += 100 + len(last["content"] or "")
                    last, n = row, n + 1 if same else 1
                    if size > held:
                        yield pa.RecordBatch.from_pylist(out, schema=kind)
                        out, size = [], 0
        if last is not None:
            out.append(close(last, n))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    small_batches(chunks.sparkSession)
    return chunks.repartition("source_file").sortWithinPartitions("source_file", F.col("chunk_id").asc_nulls_last()).mapInArrow(run, schema)


def stitch(chunks: DataFrame, r: Repair = Repair()) -> DataFrame:
    """Adjacent chunks of a source joined where a sentence, a small continuation or a level goes on; then renumbered.

    The test reads what has been joined so far, so a source is folded in order; sources are apart.
    """

    def goes_on(a: dict, b: dict) -> bool:
        x, y = (a["content"] or "").strip(), (b["content"] or "").strip()
        if a["level1"] != b["level1"] or a["level2"] != b["level2"] or not x or not y:
            return False
        if x[-1] not in ".!?:;\"')]" and y[0].islower():
            return True
        if a["heading"] == b["heading"] and min(len(x.split()), len(y.split())) < r.small_words:
            return True
        return bool(a["level3"]) and a["level3"] == b["level3"] and y[0].islower()

    def step(a: dict, row: dict) -> bool:
        if not goes_on(a, row):
            return False
        gap = " " if (a["content"] or "").strip()[-1] not in ".!?:;\"')]" else "\n\n"
        a["content"] = a["content"].strip() + gap + row["content"].strip()
        a["page_start"] = min((p for p in (a["page_start"], row["page_start"]) if p is not None), default=None)
        a["page_end"] = max((p for p in (a["page_end"], row["page_end"]) if p is not None), default=None)
        a["word_count"] = len(a["content"].split())
        a["repair_actions"] = [*a.get("repair_actions", []), f"stitched {row['chunk_id']}"]
        return True

    need = ["source_file", "chunk_id", "level1", "level2", "level3", "heading", "content", "page_start", "page_end", "word_count"]
    return _folded(chunks.select(*need), step, STITCHED, lambda a, n: {"repair_actions": [], **a})


def merge_tiny(chunks: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """Chunks of under `tiny_words` join the chunk before them if heading or level1 agree with its first part's."""

    def step(a: dict, row: dict) -> bool:
        if row["word_count"] >= c.tiny_words or (a["heading"] != row["heading"] and a["level1"] != row["level1"]):
            return False
        a["content"] += "\n\n" + row["content"]
        a["word_count"] = len(a["content"].split())
        return True

    cols = ["source_file", "chunk_id", "level1", "heading", "content", "word_count"]
    kind = "source_file string, chunk_id long, level1 string, heading string, content string, word_count long"
    return _folded(chunks.select(*cols), step, kind, lambda a, n: {**a, "chunk_id": n})


def renumbered(chunks: DataFrame) -> DataFrame:
    """chunk_seq from 1 over (source_file, chunk_id), without one task for all: ids are dealt by source, then shifted."""
    per = chunks.groupBy("source_file").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("source_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = chunks.withColumn("rn", F.row_number().over(W.partitionBy("source_file").orderBy("chunk_id")))
    return own.join(per.select("source_file", "base"), "source_file").withColumn("chunk_seq", (F.col("base") + F.col("rn")).cast("long")).drop("base", "rn")

"""Text functions: Column to Column, built-ins only unless a docstring says otherwise. Null gives null."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Characters and what they become before compatibility normalisation.
UNICODE = {
    "\u00ad": "", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2026": "...",
    "\u00a0": " ", "\ufeff": "", "\u200b": "", "\u200c": "", "\u200d": "", "\uf0b7": "•", "\uf0a7": "•",
}

# Ligatures, their glyph names and dashes.
LIGATURES = {
    "/uniFB00": "ff", "/uniFB01": "fi", "/uniFB02": "fl", "/uniFB03": "ffi", "/uniFB04": "ffl",
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\u2010": "-", "\u2013": "-", "\u2014": "-",
}

# Words that a source's title keeps in lower case.
SMALL_WORDS = ("of", "and", "the", "for", "in", "to", "with", "on", "at", "by", "from", "an")

# Starts of a sentence before which a full stop was lost.
SENTENCE_STARTS = ("If", "When", "After", "Before", "Some", "These", "Those", "This", "That", "You", "Your", "They", "It", "Talk", "Ask", "More")

#: A line's bullet or number.
BULLET = r"^(\s*)([-*•●◦▪▸►‣⁃]|\d+[.)]\s|[a-zA-Z][.)]\s|h\s)"


def strip(text: Column) -> Column:
    """Without white space (Unicode's) at both ends; `trim` takes off blanks only."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def words(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def _replaced(text: Column, table: dict[str, str]) -> Column:
    one = {a: b for a, b in table.items() if len(a) == 1 and len(b) == 1}
    gone = "".join(a for a, b in table.items() if len(a) == 1 and not b)
    text = F.translate(text, "".join(one) + gone, "".join(one.values()))
    for a, b in table.items():
        if a not in one and b:
            text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fold_unicode(text: Column) -> Column:
    """The replacements of UNICODE, without compatibility normalisation."""
    return _replaced(text, UNICODE)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation; Spark has no built-in of it, so Arrow batches go to Python."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_unicode(text: Column) -> Column:
    return nfkc(fold_unicode(text))


def fix_ocr_merges(text: Column) -> Column:
    """Puts the blank back between a word, '.', ',' or ')' and the capital that follows it."""
    for pattern in (r"([a-z])([A-Z][a-z]{2,})", r"(\.)([A-Z][a-z])", r"(,)([A-Z])", r"(\))([A-Z][a-z])"):
        text = F.regexp_replace(text, pattern, "$1 $2")
    return text


def squeeze(text: Column) -> Column:
    """Runs of blanks and tabs become one blank, none stands before a full stop or at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" \.", "."))


def clean(text: Column, compatibility: bool = True) -> Column:
    """Unicode, merged words, white space, in this order."""
    return squeeze(fix_ocr_merges(normalize_unicode(text) if compatibility else fold_unicode(text)))


def is_artifact(text: Column, known: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
    bare = strip(text)
    out = bare.isin(*known) if known else F.lit(False)
    for p in patterns:
        out = out | bare.rlike(rf"\A(?:{p})\z")
    return out


def match_key(text: Column) -> Column:
    """Lower case, dashes folded, anything but word characters, '/' and '-' a blank, squeezed."""
    low = F.translate(F.lower(text), "–—»", "-- ")
    return strip(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w\s/-]", " "), r"(?U)\s+", " "))


def strip_citations(text: Column) -> Column:
    """Without [1,2-5] and (1,2), but with a single year such as (1990); then white space is put right."""
    text = F.regexp_replace(text, r"\[[\d\s,\-–]+\]", "")
    text = F.regexp_replace(text, r"\((?!\s*(?:19|20)\d{2}\s*\))\s*\d+(?:\s*[,\-–]\s*\d+)*\s*\)", "")
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+([.,;:?])", "$1"), r"(?U)\s+", " "))


def clean_hierarchy(text: Column) -> Column:
    return strip(F.translate(strip_citations(text), "»>", ""))


def fix_ligatures(text: Column) -> Column:
    """Ligature characters and names, and words that a blank around one has split. Joins words such as 'fi nal'."""
    text = _replaced(text, LIGATURES)
    text = F.regexp_replace(text, r"\b([a-zA-Z]+)\s+(fi|fl|ff|ffi|ffl)\s+([a-zA-Z]+)\b", "$1$2$3")
    text = F.regexp_replace(text, r"\b(fi|fl|ff|ffi|ffl)\s+([a-zA-Z]+)\b", "$1$2")
    return F.regexp_replace(text, r"\b([a-zA-Z]+)\s+(fi|fl|ff|ffi|ffl)\b", "$1$2")


def restore_stops(text: Column, starts: tuple[str, ...] = SENTENCE_STARTS) -> Column:
    """A full stop before a listed word that follows a lower-case letter and a blank."""
    return F.regexp_replace(text, rf"(?<=[a-z]) (?=(?:{'|'.join(starts)})\b)", ". ")


def clean_section(text: Column) -> Column:
    """A marked-up section's text: camel case split, wrapped lines joined, empty lines squeezed."""
    text = F.translate(text, "\ufffe\ufffd", "")
    for pattern, kept in ((r"(?<=[a-z])(?=[A-Z])", " "), (r"[ \t]+", " "), (r"\n(?=[a-z])", " "), (r"\n(?=[A-Z][a-z])", " "), (r"\s+\n", "\n"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, kept)
    return strip(text)


def completed_heading(heading: Column, content: Column) -> tuple[Column, Column]:
    """(heading, content): a heading that ends in a preposition takes the content's first, lower-case word."""
    broken = heading.rlike(r"(?i)^.*\b(?:before|after|during|with|without|for|of)\s*$") & content.rlike(r"(?s)^[a-z][a-z/-]*\s+[A-Z]")
    word, rest = F.regexp_extract(content, r"^([a-z][a-z/-]*)\s+", 1), F.regexp_replace(content, r"^[a-z][a-z/-]*\s+", "")
    return F.when(broken, strip(F.concat_ws(" ", heading, word))).otherwise(heading), F.when(broken, strip(rest)).otherwise(content)


def merge_wrapped(lines: Column) -> Column:
    """Lines joined where the break falls within a sentence; bullets and '#' lines begin anew.

    A line's break depends on the end of the line before it and its own start, which holds for joined lines
    too, since the end of what was joined is that line's. So breaks are marked where they are and the lines joined once.
    Lines hold no line feeds.
    """
    def joins(prev: Column, line: Column) -> Column:
        wrapped = prev.rlike(r"[a-z,;:\-]\z") & line.rlike(r"\A[a-z(]")
        open_ = ~prev.rlike(r"[.!?:\"']\z") & line.rlike(r"\A[a-z]")
        return ~line.rlike(BULLET) & ~line.startswith("#") & (wrapped | open_)

    gap = lambda line, i: F.when(i == 0, F.lit("")).when(joins(F.get(lines, i - 1), line), F.lit(" ")).otherwise(F.lit("\n"))
    whole = F.array_join(F.transform(lines, lambda line, i: F.concat(gap(line, i), line)), "")
    return F.when(F.size(lines) == 0, lines).otherwise(F.split(whole, "\n", -1))


def clean_paragraph(text: Column) -> Column:
    """Each line cleaned, empty ones dropped, wrapped ones joined."""
    lines = F.filter(F.transform(F.split(fold_unicode(text), "\n"), lambda x: squeeze(fix_ocr_merges(x))), lambda x: x != "")
    return F.array_join(merge_wrapped(lines), "\n")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda x: x != "")


def upper_ratio(text: Column) -> Column:
    """Upper-case letters by letters; 0 without letters."""
    n = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(n > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / n).otherwise(F.lit(0.0))


def title_words(text: Column) -> Column:
    return F.size(F.filter(words(text), lambda w: w.rlike(r"\A\p{Lu}")))


def breadcrumb(text: Column, separators: str = "»") -> Column:
    return F.filter(F.transform(F.split(text, f"[{separators}]"), lambda x: squeeze(x)), lambda x: x != "")


def pretty_source(name: Column) -> Column:
    """A file's or address's last part as a title: no .pdf, '-' and '_' blanks, small words lower."""
    base = F.element_at(F.split(name, "/"), -1)
    base = F.translate(F.regexp_replace(base, r"(?i)\.pdf$", ""), "-_", "  ")
    cased = F.transform(words(base), lambda w: F.when(F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))))
    out = F.array_join(cased, " ")
    out = F.concat(F.upper(F.left(out, F.lit(1))), F.substr(out, F.lit(2)))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("Unknown Reference")).otherwise(out)


def joined(sep: str, *parts: Column) -> Column:
    """Non-blank parts with `sep` between."""
    return F.concat_ws(sep, *[F.when(strip(p) != "", p) for p in parts])


def search_text(kind: str, heading: Column, levels: list[Column], content: Column, prefix: str = "") -> Column:
    """What an index sees of a chunk: 'content' (content, heading), 'all' (heading, levels, content), 'path'
    (levels > heading. content), 'lines' (one a line) or 'titled' (heading. content)."""
    body = F.coalesce(content, F.lit(""))
    path = joined(" > ", *levels, heading)
    out = {
        "content": lambda: F.concat(body, F.lit(" "), F.coalesce(heading, F.lit(""))),
        "all": lambda: joined(" ", heading, *levels, content),
        "path": lambda: F.when(path != "", F.concat(path, F.lit(". "), body)).otherwise(body),
        "lines": lambda: joined("\n", heading, *levels, content),
        "titled": lambda: F.concat(F.coalesce(heading, F.lit("")), F.lit(". "), body),
    }[kind]()
    return F.concat(F.lit(prefix), out) if prefix else out


def preview(text: Column, chars: int = 350) -> Column:
    """Whole sentences up to `chars` characters; at least a cut first one."""
    parts = F.split(strip(F.regexp_replace(text, r"(?U)\s+", " ")), r"(?<=[.!?]) ")
    kept = F.aggregate(parts, F.struct(F.lit("").alias("t"), F.lit(False).alias("full")), lambda a, s: F.when(a["full"] | (F.length(a["t"]) + F.length(s) + 1 > chars), F.struct(a["t"].alias("t"), F.lit(True).alias("full"))).otherwise(F.struct(F.when(a["t"] == "", s).otherwise(F.concat_ws(" ", a["t"], s)).alias("t"), F.lit(False).alias("full"))))
    return F.when(kept["t"] == "", F.left(strip(text), F.lit(chars))).otherwise(kept["t"])


def suspicious_merges(text: Column, starts: tuple[str, ...] = SENTENCE_STARTS) -> Column:
    """Places where a lower-case letter, a blank and a listed start follow on each other."""
    return F.regexp_count(text, F.lit(rf"[a-z] (?:{'|'.join(starts)})\b"))


def json_span(text: Column, schema: str) -> Column:
    """The JSON array or object in a model's answer, parsed; null where there is none or it is broken."""
    span = F.regexp_extract(text, r"(?s)\[.*\]" if schema.lstrip().lower().startswith("array") else r"(?s)\{.*\}", 0)
    return F.when(span != "", F.from_json(span, schema))


def is_greeting(text: Column) -> Column:
    return F.lower(strip(text)).isin("hi", "hello", "hey", "good morning", "good afternoon", "good evening", "how are you", "thanks", "thank you")


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 * longest common subsequence / both lengths, as an insert-and-delete ratio; 100 for two empty strings."""
    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x and not y:
            return 100.0
        # bit-parallel longest common subsequence
        places: dict[str, int] = {}
        for i, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for c in y:
            u = row & places.get(c, 0)
            row = (row + u | row - u) & full
        return 200.0 * (len(x) - row.bit_count()) / (len(x) + len(y))

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def optimized_query(text: Column, phrases: dict[str, str], spelling: dict[str, str], abbreviations: dict[str, str], symptoms: dict[str, list[str]], emergency: tuple[str, ...] = (), unsafe: tuple[str, ...] = ()) -> Column:
    """A query's rewriting as a struct (optimized, terms, confidence, corrected, emergency, unsafe) by the caller's tables.

    An exact phrase is replaced; else words are corrected, abbreviations written out and symptoms' terms added.
    """
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    low = strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    has = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: F.contains(low, p)) if ps else F.lit(False)
    phrase = F.try_element_at(as_map(phrases), low)
    right = F.transform(F.split(low, " "), lambda w: F.coalesce(F.try_element_at(as_map(spelling), w), w))
    wrong = F.exists(F.split(low, " "), lambda w: F.map_contains_key(as_map(spelling), w)) if spelling else F.lit(False)
    full = F.transform(right, lambda w: F.coalesce(F.try_element_at(as_map(abbreviations), w), w))
    added = F.flatten(F.transform(full, lambda w: F.coalesce(F.split(F.try_element_at(as_map({k: "\t".join(v) for k, v in symptoms.items()}), w), "\t"), F.array().cast("array<string>"))))
    meant = F.filter(F.transform(right, lambda w: F.try_element_at(as_map(abbreviations), w)), lambda x: x.isNotNull())
    terms = F.slice(F.array_distinct(F.concat(meant, added)), 1, 8)
    return F.struct(
        F.when(low == "", "").when(phrase.isNotNull(), phrase).otherwise(strip(F.array_join(F.concat(full, added), " "))).alias("optimized"),
        F.when(low == "", F.array().cast("array<string>")).when(phrase.isNotNull(), F.array(F.split(phrase, " ")[0])).otherwise(terms).alias("terms"),
        F.when(low == "", 0.5).when(phrase.isNotNull(), 0.96).when(wrong, 0.82).otherwise(0.88).alias("confidence"),
        (phrase.isNull() & wrong).alias("corrected"), has(emergency).alias("emergency"), has(unsafe).alias("unsafe"),
    )

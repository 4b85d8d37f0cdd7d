"""Filters and predicates on lines, blocks and chunks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import Cleaning
from tessera.functions import text as T


#: A line of nothing but marks.
SYMBOLS = r"\A[®Ü•*=\-_/|]+\z"


def metadata(filters: dict[str, Any]) -> Column:
    """AND over columns: one of the values where a list is given, else null-safe equality."""
    out = F.lit(True)
    for name, value in filters.items():
        out = out & (F.col(name).isin(*value) if isinstance(value, list | tuple | set) else F.col(name).eqNullSafe(F.lit(value)))
    return out


def contains_any_case(column: str, value: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(value.lower()))


def first_filled(*columns: str) -> Column:
    """The first of several fields that isn't blank."""
    return F.coalesce(*[F.when(T.strip(F.col(c)) != "", F.col(c)) for c in columns])


def is_navigation(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), p)) if phrases else F.lit(False)


def is_toc_line(text: Column) -> Column:
    flat = T.strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return flat.rlike(r"^[A-Z][A-Za-z'()/,& -]+\s+\d{1,3}(?:[-–]\d{1,3})?$") | (flat.rlike(r"^\d+\s+[A-Z]") & (T.word_count(flat) <= 6))


def is_toc_like(content: Column) -> Column:
    """Three or more numbers before a word in the first 220 characters."""
    return F.regexp_count(F.left(content, F.lit(220)), F.lit(r"\b\d+\s+[A-Za-z]")) >= 3


def is_bullet(line: Column) -> Column:
    return line.rlike(r"^\s*[-*•●◦▪▸►‣⁃]\s|^\s*\d+[.)]\s|^\s*[a-zA-Z][.)]\s")


def is_url(text: Column) -> Column:
    return text.rlike(r"(?i)https?://|www\.|\b\S+\.(?:org|com|edu|gov)\b")


def is_symbol_noise(text: Column) -> Column:
    return T.strip(text).rlike(SYMBOLS)


def is_institution(text: Column) -> Column:
    """A line that names an author's degree or an institution."""
    return text.rlike(r"\b(?:MD|PhD|MPH|RN|MSc|MBBS)\b|\b(?:University|Hospital|Institute|Department|School of|College of)\b")


def is_bibliography(text: Column, journals: tuple[str, ...] = ("J Clin", "N Engl J Med", "Lancet", "JAMA", "BMJ", "guideline", "guidelines")) -> Column:
    years = F.regexp_count(text, F.lit(r"\b(?:19\d{2}|20[0-2]\d)\b"))
    named = F.regexp_count(text, F.lit(rf"(?i)\b(?:{'|'.join(journals)})\b"))
    items = F.regexp_count(text, F.lit(r"\A\b\d+[.)]\s+")) + F.regexp_count(text, F.lit(r"\A\[\d+\]\s+"))
    marks = F.regexp_count(text, F.lit(r"(?i)\b(?:et al\.|pp\.|vol\.|journal|clinical trial|recommendation|consensus)\b"))
    return (T.word_count(text) >= 3) & (((years >= 2) & (named >= 1)) | ((years >= 1) & (marks >= 2)) | (items >= 2))


def is_visual_noise(text: Column, fonts: Column, size: Column, x: Column, decorative: tuple[str, ...] = ("Wingdings",), banned: tuple[str, ...] = ()) -> Column:
    """Ornament fonts, large short text, a narrow right column, any link."""
    n, has = T.word_count(text), lambda names: F.exists(fonts, lambda f: F.exists(F.array(*map(F.lit, names)), lambda b: F.contains(f, b))) if names else F.lit(False)
    hosts = F.regexp_count(text, F.lit(r"\.org")) + F.regexp_count(text, F.lit(r"\.gov"))
    return has(banned) | (has(decorative) & (n <= 12)) | ((size >= 13.5) & (n <= 20)) | ((size >= 15) & (x > 300)) | F.contains(text, F.lit("http")) | (hosts >= 2) | ((n <= 8) & (x > 300))


def keeps_block(text: Column, margin: Column, visual: Column, bibliography: Column, artifacts: tuple[str, ...] = ()) -> Column:
    """A block with a text that is in no margin, no visual noise, no bibliography and no known artifact."""
    flags = [F.coalesce(c, F.lit(False)) for c in (margin, visual, bibliography)]
    return (F.coalesce(text, F.lit("")) != "") & ~text.isin(*artifacts) & ~(flags[0] | flags[1] | flags[2])


def is_lead_in(keeps: Column, size: Column, least: float = 12.5, heading: float = 19.0) -> Column:
    """A block that is kept and larger than the text but smaller than a heading."""
    return keeps & (size >= least) & (size < heading)


def is_long_enough(content: Column, page: Column, least: int = 80) -> Column:
    """Contents of at least `least` characters that aren't on the first page (0)."""
    return (F.length(F.coalesce(content, F.lit(""))) >= least) & (page != 0)


def is_page_noise(text: Column, min_y: Column, max_y: Column, size: Column, height: float = 792.0, boilerplate: tuple[str, ...] = ()) -> Column:
    """A year at the top, anything in the bottom margin, bare numbers, small boilerplate."""
    small = F.exists(F.array(*map(F.lit, boilerplate)), lambda b: F.contains(text, b)) & (size < 16) if boilerplate else F.lit(False)
    return ((min_y < 40) & text.rlike(r"\A\d{4}\z")) | (max_y > height - 30) | text.rlike(r"\A\d+\z") | small


def in_margin(min_y: Column, max_y: Column, top: float, bottom: float) -> Column:
    """The header and footer zones of a fixed page layout."""
    return (max_y < top) | (min_y > bottom)


def removal_reason(text: Column, max_y: Column, kind: Column, header: Column, footer: Column, c: Cleaning = Cleaning(), stripped: bool = False) -> Column:
    """Why a block goes, first reason first; null where it stays. header, footer: whether its text repeats there."""
    bare = text if stripped else T.strip(text)
    return (
        F.when(header, "repeated_header")
        .when(footer, "repeated_footer")
        .when(bare.rlike(r"\A\d{1,4}\z"), "page_number")
        .when((max_y > c.page_height - c.footer_band) & (T.word_count(bare) <= c.footer_max_words), "bottom_footer")
        .when(bare.isin(*c.known_artifacts), "known_artifact")
        .when(bare.rlike(SYMBOLS), "symbol_noise")
        .when(bare.rlike(rf"\A(?:{'|'.join(c.noise_patterns)})\z") if c.noise_patterns else F.lit(False), "noise_pattern")
        .when(is_navigation(bare, c.navigation), "navigation")
        .when(is_toc_line(bare), "toc_line")
        .when(kind.isin("header", "footer"), "parser_header_footer")
    )


def is_references(heading: Column) -> Column:
    return F.contains(F.upper(F.coalesce(heading, F.lit(""))), F.lit("REFERENCES"))


def is_heading_like(line: Column) -> Column:
    """'#', or up to 12 words without a sentence's end that are mostly capitals or capitalised."""
    flat = T.squeeze(F.regexp_replace(line, r"(?U)\s+", " "))
    n = T.word_count(flat)
    return (flat != "") & (flat.startswith("#") | ((n <= 12) & ~flat.rlike(r"[.!?]\z") & ((T.upper_ratio(flat) >= 0.6) | (T.title_words(flat) >= F.greatest(F.lit(2), n - 1)))))


def is_vignette(question: Column, phrases: tuple[str, ...] = ()) -> Column:
    """A case description: over 250 characters, or a phrase of the caller's."""
    return (F.length(question) > 250) | is_navigation(question, phrases)

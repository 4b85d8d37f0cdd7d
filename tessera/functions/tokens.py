"""Tokenizers, as arrays of strings. ASCII letters and digits only: accented words fall apart, here as in the SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tokenizer A leaves out, in alphabetical order.
STOP_WORDS = (
    "a about after all also an and any are as at be been being between both but by can could do does each few for from get got had has have her here him his how "
    "if in into is it its just like may more most must no nor not of on only or other our out own same she should so some such than that the their them there these "
    "they this those to very was we were what when which will with would you your"
).split()

# Words that open a sentence which leans on the one before, where sections are packed.
TRANSITIONS = "additionally also consequently furthermore hence however meanwhile moreover nevertheless nonetheless therefore thus".split()
PRONOUNS = "it its that these they this those".split()
# The same where documents are split by meaning.
OPENERS = "also and because but however instead meanwhile moreover otherwise plus so then therefore thus yet".split()
LIGHT_PRONOUNS = "it its that their them these they this those".split()


def raw(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def plain(text: Column) -> Column:
    """Tokenizer A: no stop words, none of one character."""
    return F.filter(raw(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def stem(token: Column) -> Column:
    """Plurals: ies to y; a last s off, but not of ss; words over four letters only."""
    long = F.length(token) > 4
    return F.when(long & token.endswith("ies"), F.concat(F.left(token, F.length(token) - 3), F.lit("y"))).when(long & token.endswith("s") & ~token.endswith("ss"), F.left(token, F.length(token) - 1)).otherwise(token)


def stemmed(text: Column) -> Column:
    """Tokenizer B: every token, stemmed."""
    return F.transform(raw(text), stem)


def longer(text: Column) -> Column:
    """Tokenizer C: tokens of over one character."""
    return F.filter(raw(text), lambda t: F.length(t) > 1)


def meaningful(text: Column, stop: tuple[str, ...] | list[str] = STOP_WORDS) -> Column:
    return F.filter(stemmed(text), lambda t: ~t.isin(*stop))


def terms(text: Column, stop: tuple[str, ...] | list[str] = STOP_WORDS) -> Column:
    return F.array_distinct(meaningful(text, stop))


TOKENIZERS = {"plain": plain, "stemmed": stemmed, "longer": longer}


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by blanks."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def first_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"[A-Za-z']+", 0))


def is_transition(text: Column) -> Column:
    return first_word(text).isin(*OPENERS)


def is_pronoun(text: Column) -> Column:
    return first_word(text).isin(*LIGHT_PRONOUNS)


def starts_lower(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[(\"“]+", "").rlike(r"\A\p{Ll}")


def is_awkward_start(text: Column, words: Column) -> Column:
    return (F.trim(text) == "") | is_transition(text) | starts_lower(text) | (is_pronoun(text) & (words <= 12))


def is_orphan(text: Column, words: Column) -> Column:
    """A lower-case scrap of up to five words."""
    return (words <= 5) & ((F.trim(text) == "") | F.trim(text).rlike(r"\A[a-z][a-z,\s-]*[.,;:!?]?\z"))

"""Golden values of text functions, tokenizers and predicates."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions import text as T
from tessera.functions import tokens as K


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("fn", "given", "want"),
    [
        (T.strip, "\t  a b \n", "a b"),
        (T.strip, None, None),
        (T.word_count, " a b  c\n", 3),
        (T.word_count, "", 0),
        (T.normalize_unicode, "ﬁne­ly “q”… Ａ", 'finely "q"... A'),
        (T.fix_ocr_merges, "treatmentYour doctor.Then go,Now (x)Yes iOs", "treatment Your doctor. Then go, Now (x) Yes iOs"),
        (T.squeeze, "  a \t b . c", "a b. c"),
        (T.strip_citations, "A [5-7] b [1, 2] c (3) d (1,2) e (1990) f (19901) .", "A b c d e (1990) f."),
        (T.fix_ligatures, "strati fi cation of the ﬁ nal", "stratification of thefinal"),
        (T.clean_hierarchy, "A » B > C (1)", "A  B  C"),
        (T.match_key, "A – B/c »  D!", "a - b/c d"),
        (T.pretty_source, "x/y/the-art_of the_WAR.pdf", "The Art of the War"),
        (T.pretty_source, "", "Unknown Reference"),
        (T.clean_section, "oneTwo\nthree\n\n\n\nX  y", "one Two three\nX y"),
        (T.restore_stops, "we stop When done", "we stop. When done"),
        (T.clean_paragraph, "A line that\nwraps on,\n\nhere. Done\n- item", "A line that wraps on, here. Done\n- item"),
    ],
)
def test_text(spark, fn, given, want):
    assert one(spark, fn(F.col("t")), t=given) == want


def test_wrapped_lines(spark):
    assert one(spark, T.merge_wrapped(F.col("l")), l=["Ends, ", "Ends,", "and on", "# no", "low", "- b", "Cap", "end.", "low"]) == ["Ends, ", "Ends, and on", "# no low", "- b", "Cap end.", "low"]


def test_completed_heading(spark):
    df = spark.createDataFrame([("Life with", "cancer Treatment is")], "h string, c string")
    h, c = T.completed_heading(F.col("h"), F.col("c"))
    assert tuple(df.select(h, c).first()) == ("Life with cancer", "Treatment is")


def test_tokens(spark):
    t = "The symptoms, studies of glass é and x"
    assert one(spark, K.plain(F.col("t")), t=t) == ["symptoms", "studies", "glass"]
    assert one(spark, K.stemmed(F.col("t")), t=t) == ["the", "symptom", "study", "of", "glass", "and", "x"]
    assert one(spark, K.ngrams(F.split("t", " "), 2), t="a b c") == ["a b", "b c"]
    assert one(spark, K.ngrams(F.split("t", " "), 2), t="a") == []


def test_fuzzy(spark):
    assert one(spark, T.fuzzy_ratio(F.col("a"), F.col("b")), a="abcd", b="abxd") == pytest.approx(75.0)
    assert one(spark, T.fuzzy_ratio(F.col("a"), F.col("b")), a="", b="") == 100.0


def test_json_span(spark):
    assert one(spark, T.json_span(F.col("t"), "array<string>"), t='Sure: ["a", "b"] ok') == ["a", "b"]
    assert one(spark, T.json_span(F.col("t"), "array<string>"), t="none") is None


def test_optimized_query(spark):
    q = T.optimized_query(F.col("t"), {"high bp": "hypertension care"}, {"hart": "heart"}, {"bp": "blood pressure"}, {"heart": ["angina"]}, ("heart",))
    a = one(spark, q, t="Hart  bp")
    assert (a["optimized"], a["terms"], a["confidence"]) == ("heart blood pressure angina", ["blood pressure", "angina"], 0.82)
    assert one(spark, q, t="high BP")["confidence"] == 0.96
    assert one(spark, q, t=" ")["confidence"] == 0.5


def test_preview(spark):
    assert one(spark, T.preview(F.col("t"), 12), t="One two. Three four five. Six.") == "One two."


@pytest.mark.parametrize(
    ("fn", "given", "want"),
    [
        (P.is_toc_line, "Staging and care 42", True),
        (P.is_toc_line, "42 Staging care", True),
        (P.is_toc_line, "plain text", False),
        (P.is_bullet, "  - item", True),
        (P.is_bibliography, "See (2001) and (2003) in Lancet", True),
        (P.is_bibliography, "2001 2003", False),
        (P.is_toc_like, "1 Aa 2 Bb 3 Cc", True),
        (P.is_heading_like, "# a", True),
        (P.is_heading_like, "The Long Title", True),
        (P.is_heading_like, "A sentence ends.", False),
        (P.is_symbol_noise, "**--", True),
    ],
)
def test_predicates(spark, fn, given, want):
    assert one(spark, fn(F.col("t")), t=given) is want


def test_metadata_null_equals_null(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "i int, s string")
    assert [r["i"] for r in df.where(P.metadata({"s": None})).collect()] == [1]
    assert [r["i"] for r in df.where(P.metadata({"s": ["a", "b"]})).orderBy("i").collect()] == [2, 3]

import re
from collections import Counter

import pytest

from tessera.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x):
    x = x or ""
    w = W.findall(x)
    seen, cover = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    lines = [line for line in x.split("\n") if W.search(line)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in x), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_base_counts(docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.judge(docs).collect():
        assert (r["q_words"], r["q_word_chars"], r["q_symbols"], r["q_dup_lines"], r["q_repeat_words"], r["q_base_failed"]) == brute(text[r["doc_id"]])


def test_agrees_with_labels(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.judge(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("q_words >= 20").select("q_kept", "quality").collect()
    assert sum(r["q_kept"] == (r["quality"] == 1) for r in got) > 0.97 * len(got)


@pytest.mark.parametrize(("line", "why"), [("Home | News | Mail | More", "navigation"), ("Skip to content", "navigation"), ("Read more", "navigation"), ("ab### cd%%% ef&&& gh", "symbols"), ("THIS!! IS!! LOUD!!", "shouting"), ("All rights reserved.", "boilerplate"), ("we went on and on with no mark at all", "punctuation"), ("A short title", None), ("A sentence that ends well, as it should do.", None), ("", None)])
def test_line_rules(spark, line, why):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(line,)], "l string").select(quality.line_fails(F.col("l"))).first()[0] == why


def test_cleaned_text(spark):
    good = "This is a sentence of several words that is fine, and it goes on for long enough to pass the rules. Yes."
    more = "Another line has other words, all of them new, to follow on the first one here."
    df = spark.createDataFrame([(1, good + "\nRead more\n" + more), (2, "\n".join(["ab### cd%%% ef&&& gh x y z"] * 1 + ["q w e r t y u i o p a s d f g h j k l z x c"]))], "doc_id int, text string")
    got = quality.clean(df).collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [(1, good + "\n" + more)]


def test_odd_rows(odd):
    rows = odd.collect()
    got = quality.judge(odd).collect()
    assert len(got) == len(rows)
    assert Counter((r["q_words"], r["q_repeat_words"], r["q_base_failed"]) for r in got) == Counter((b[0], b[4], b[5]) for b in map(brute, (r["text"] for r in rows)))
    kept = quality.clean(odd)
    assert kept.columns == odd.columns and [(r["doc_id"], r["q_text"]) for r in kept.collect()] == [(None, "x")]


def test_other_columns_stay_whatever_their_names(spark):
    df = spark.createDataFrame([("Some words, and a few more of them. " * 9, "mine", "gone", 1)], "`a.text` string, q_mine string, q_text string, c0 int")
    got = quality.judge(df, text="a.text")
    assert got.columns == ["a.text", "q_mine", "c0", *quality.ADDED]
    row = got.first()
    assert row["q_mine"] == "mine" and row["c0"] == 1 and row["q_text"] == row["a.text"]
    assert quality.clean(df, text="a.text").columns == df.columns

"""Layout, chunking, validation, search, measures and learning on small fixtures."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Chunking, Search
from tessera.operators import adapters, chunking, layout, metrics, relational, search, tuning, validation


@pytest.fixture(scope="module")
def blocks(spark):
    rows = []
    for p in range(3):
        rows += [("s", p, 0, "Guide to care", 20.0, 30.0, 9.0, False, "text", 0), ("s", p, 9, f"{p}", 760.0, 770.0, 9.0, False, "text", 0)]
    rows += [("s", 0, 1, "FIRST PART", 100.0, 120.0, 22.0, True, "text", 0), ("s", 0, 2, "body text with more than eight words in it here.", 130.0, 140.0, 11.0, False, "text", 0), ("s", 1, 1, "1.2 Smaller Thing", 100.0, 110.0, 17.0, True, "text", 0), ("s", 1, 2, "more body text with more than eight words in it.", 130.0, 140.0, 11.0, False, "text", 0), ("s", 2, 1, "Contents follow 12", 100.0, 110.0, 11.0, False, "text", 0)]
    return spark.createDataFrame(rows, "source_file string, page_index int, block_index int, text string, min_y double, max_y double, max_font_size double, is_bold boolean, doc_item_type string, heading_level int")


def test_noise(blocks):
    kept, why = layout.filter_noise(blocks)
    assert {r["reason"]: r["blocks"] for r in why.collect()} == {"repeated_header": 3, "page_number": 3, "toc_line": 1, "kept": 4}
    assert kept.count() == 4


def test_headings_and_sections(blocks):
    kept, _ = layout.filter_noise(blocks)
    h = layout.detect_headings(kept)
    got = {r["text"]: (r["is_heading"], r["level"]) for r in h.collect()}
    assert got["FIRST PART"] == (True, 1) and got["1.2 Smaller Thing"] == (True, 2) and not got["body text with more than eight words in it here."][0]
    s = layout.sections(h).orderBy("section_id").collect()
    assert [(r["heading"], r["level1"], r["level2"]) for r in s] == [("FIRST PART", "FIRST PART", None), ("1.2 Smaller Thing", "FIRST PART", "1.2 Smaller Thing")]


def test_breadcrumbs(spark):
    c = spark.createDataFrame([("s", 0, 0, "A » B"), ("s", 0, 3, "A » Staging")], "source_file string, page_index int, block_index int, text string")
    h = spark.createDataFrame([("s", 0, 4, "Staging")], c.schema)
    r = layout.breadcrumb_for(h, c).first()
    assert r["score"] == 3 and r["crumb"] == ["A", "Staging"]


def test_sentences():
    assert chunking.split_sentences("See Dr. Smith now. He waits.\n- item one\nThen go. (Yes.) \"No\"") == ["See Dr. Smith now.", "He waits.", "- item one", "Then go.", '(Yes.) "No"']
    assert chunking.split_sentences(None) == []


def test_pack_covers_all_sentences():
    c = Chunking(min_words=5, target_words=12, max_words=20, overlap_sentences=1, tiny_words=3)
    s = [f"Word{i} " + "x " * (i % 7) + "end." for i in range(60)]
    out = chunking.pack(s, c)
    for x in s:
        assert any(x in o for o in out)
    assert all(len(o.split()) <= 20 + 3 for o in out)
    flat = chunking.pack(s, Chunking(target_words=12, max_words=20, overlap_sentences=0, tiny_words=0))
    assert " ".join(flat) == " ".join(s)


def test_semantic_ranges_cover():
    units = [(f"Topic{i // 5} term{i} alpha beta gamma.", i // 4) for i in range(40)]
    r = chunking.semantic_ranges(units, 10, 20, 40, 0)
    assert r[0][0] == 0 and r[-1][1] == 40


@pytest.mark.parametrize("seed", range(6))
def test_semantic_ranges_equal_a_plain_version(seed):
    """The survey's conditions as they stand, every sum and union made anew."""
    rng = random.Random(seed)
    opens = "and but because so then therefore however also instead meanwhile moreover otherwise plus yet thus".split()
    leans = "this that these those it they them their its".split()
    vocabulary = [f"word{i}" for i in range(12)] + ["And", "They", "lower", "Upper"]
    units = [(" ".join([rng.choice(["The", "And", "They", "also", "Its"]), *(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))]) + ".", i // rng.randint(1, 4)) for i in range(rng.randint(0, 90))]
    least, target, most, overlap = rng.choice([(10, 25, 40, 1), (5, 9, 15, 2), (20, 30, 60, 0)])
    words = [len(t.split()) for t, _ in units]
    terms = [chunking._terms(t) for t, _ in units]

    def awkward(t):
        first = re.search(r"[A-Za-z']+", t).group().lower()
        return first in opens or t[0].islower() or (first in leans and len(t.split()) <= 12)

    def splits(start, end):
        size = sum(words[start:end])
        then = size + words[end]
        if size >= least and then > most:
            return True
        if size < least:
            return False
        near = set().union(*terms[max(start, end - 3) : end])
        alike = len(near & terms[end]) / len(near | terms[end]) if near and terms[end] else 0.0
        fresh = units[end][1] != units[end - 1][1]
        return (size >= target and fresh) or (size >= target and alike < 0.08) or (fresh and alike < 0.15 and then >= target)

    want, start = [], 0
    while start < len(units):
        end = start + 1
        while end < len(units) and not splits(start, end):
            end += 1
        first = start
        while first < end - 1 and awkward(units[first][0]) and sum(words[first + 1 : end]) >= least:
            first += 1
        want.append((first, end))
        if end >= len(units):
            break
        if overlap <= 0:
            start = end
            continue
        start = max(start + 1, end - overlap)
        while start < end - 1 and awkward(units[start][0]):
            start += 1
    assert chunking.semantic_ranges(units, least, target, most, overlap) == want


def test_stitch(spark):
    rows = [("f", 1, "A", None, None, "h", "It goes on and", 1, 1, 4), ("f", 2, "A", None, None, "x", "ends here.", 2, 2, 2), ("f", 3, "B", None, None, "y", "Other.", 3, 3, 1), ("g", 1, "A", None, None, "h", "lower", 1, 1, 1)]
    df = spark.createDataFrame(rows, "source_file string, chunk_id long, level1 string, level2 string, level3 string, heading string, content string, page_start int, page_end int, word_count long")
    got = {(r["source_file"], r["chunk_id"]): r for r in chunking.stitch(df).collect()}
    assert len(got) == 3 and got["f", 1]["content"] == "It goes on and ends here." and got["f", 1]["page_end"] == 2 and got["f", 1]["repair_actions"] == ["stitched 2"]


def test_boilerplate(spark):
    df = spark.createDataFrame([("s", i, i, f"Common header line\nbody {i}\nend {i}") for i in range(5)] + [("s", 9, 9, "Common header lime")], "source_file string, chunk_id long, page_start int, content string")
    patterns = chunking.learn_boilerplate(df.where("chunk_id < 9"))
    assert [r["line"] for r in patterns.collect()] == ["Common header line"]
    got = {r["chunk_id"]: r["content"] for r in chunking.strip_boilerplate(df, patterns, ["source_file", "chunk_id"]).collect()}
    assert got[0] == "body 0\nend 0" and got[9] == "Common header lime"


def test_healed(spark):
    df = spark.createDataFrame([("What options are", "there for me\nText follows.")], "h string, c string")
    h, c = chunking.healed(F.col("h"), F.col("c"))
    assert tuple(df.select(h, c).first()) == ("What options are there for me", "Text follows.")


def test_quality(spark):
    df = spark.createDataFrame([("k", "", "short", None, "b", None)], "chunk_id string, heading string, content string, level1 string, level2 string, level3 string")
    r = validation.validate(df).first()
    assert r["quality"]["heading"] == 0 and r["quality"]["content"] == 40.0 and [i["code"] for i in r["issues"]] == ["H001", "C002", "C006", "H009"]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma gamma"), (3, "delta")], "doc_id long, text string")


@pytest.mark.parametrize(("query", "want"), [("alpha", {1: 0.063853, 2: 0.052125}), ("gamma", {2: 0.628708}), ("alpha gamma", {1: 0.063853, 2: 0.680834}), ("gamma gamma", {2: 1.257417})])
def test_bm25_goldens(spark, tiny, query, want):
    q = spark.createDataFrame([(0, query)], "item_id long, text string")
    got = {r["key"]: r["score"] for r in search.search_sparse(tiny, q, 10).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_filters_keep_scores(spark, tiny):
    q = spark.createDataFrame([(0, "alpha gamma")], "item_id long, text string")
    every = {r["key"]: r["score"] for r in search.search_sparse(tiny, q, 10).collect()}
    for r in search.search_sparse(tiny, q, 10, filters={"doc_id": [2]}).collect():
        assert r["key"] == 2 and r["score"] == pytest.approx(every[2])


def test_rrf_golden(spark):
    ranks = lambda rows: spark.createDataFrame(rows, "query_id long, key long, score double, rank long")
    got = {r["key"]: r["score"] for r in search.rrf(ranks([(0, 1, 1.0, 2), (0, 2, 1.0, 10)]), ranks([(0, 1, 1.0, 5), (0, 2, 1.0, 1)]), 5, Search(alpha=0.5)).collect()}
    assert got == {1: pytest.approx(0.015757, abs=1e-6), 2: pytest.approx(0.015340, abs=1e-6)}


def test_dense_blocks_equal_broadcast(spark, sf_dir):
    i = search.build_dense(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), dim=16)
    q = i.where("key < 9").select(F.col("key").alias("query_id"), F.col("vec").alias("qvec"))
    a, b = (sorted(map(tuple, search.search_dense(i, q, 3, most=m).select("query_id", "key", "rank").collect())) for m in (1 << 20, 400))
    assert a == b and len(a) == 27


def test_budget(spark):
    rows = [(0, 0, 1, 1, 5), (0, 0, 2, 2, 6), (0, 0, 3, 3, 1), (0, 1, 1, 2, 6), (0, 1, 2, 4, 5)]
    got = search.budgeted(spark.createDataFrame(rows, "question_id long, sub_no int, rank int, key long, chars long"), 10)
    assert [(r["sub_no"], r["key"]) for r in got.orderBy("sub_no", "rank").collect()] == [(0, 1), (1, 4)]


def test_ranking_goldens(spark):
    ranked = spark.createDataFrame([(0, k, k) for k in range(1, 6)] + [(1, k, k) for k in range(1, 6)], "query_id long, key long, rank long")
    rel = spark.createDataFrame([(0, 1), (0, 3), (0, 99), (1, 3), (1, 3)], "query_id long, key long")
    a, b = metrics.ranking(ranked, rel).orderBy("query_id").collect()
    assert a["ndcg"] == pytest.approx(0.703918, abs=1e-6) and a["recall"] == pytest.approx(2 / 3)
    assert b["mrr"] == pytest.approx(1 / 3) and b["recall"] == 1.0


def test_overlap(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat"), ("a b c d", "x y"), (None, "")], "a string, b string")
    same, none, empty = (r["m"] for r in df.select(metrics.overlap("a", "b").alias("m")).collect())
    assert same["rougeL"] == same["bleu2"] == same["gleu"] == 1.0 and none["rouge1"] == none["bleu1"] == none["meteor"] == 0.0 and empty["rougeLsum"] == 0.0


def test_beta_golden(spark):
    r = tuning.beta_posterior(spark.createDataFrame([("a", 0.5), ("a", 1.0)], "arm string, reward double")).first()
    assert (r["alpha"], r["beta"], r["mean"]) == (2.5, 1.5, 0.625)


def test_thompson_prefers_the_better(spark):
    p = spark.createDataFrame([("a", 90.0, 10.0), ("b", 10.0, 90.0)], "arm string, alpha double, beta double")
    assert tuning.thompson(p, 3) == "a"


def test_gaussian_search():
    s = tuning.GaussianSearch(space=(tuning.Parameter("alpha", 0.0, 1.0),))
    x = np.array([[0.1], [0.9]])
    mean, spread = s.posterior(x, np.array([1.0, 0.0]), x)
    assert mean == pytest.approx([1.0, 0.0], abs=1e-3) and spread.max() < 0.02
    done = tuning.episodes(lambda q, p: 1 - (p["alpha"] - 0.7) ** 2, ["q"], s, 14)
    assert done[-1]["best"] > 0.97


def test_relational(spark):
    a = spark.createDataFrame([("s", 1, "x"), ("s", 1, "y"), ("T", 2, "z")], "source_file string, chunk_id long, v string")
    assert relational.first_of(a, ["source_file", "chunk_id"], ["v"]).count() == 2
    assert relational.replace_by_source(a, a.limit(0)).count() == 3
    assert relational.insert_absent(a, spark.createDataFrame([("s", 1, "q"), ("s", 3, "n")], a.schema), ["source_file", "chunk_id"]).count() == 4


def test_parser_chain(spark):
    class Broken:
        def parse(self, data):
            raise ValueError("no")

    files = spark.createDataFrame([("d/a.txt", bytearray(b"# Head\nbody")), ("d/b.txt", bytearray(b""))], "path string, content binary")
    got = {r["source_file"]: r for r in adapters.parse_files(files, [("broken", Broken), ("plain", adapters.PlainTextParser)]).collect()}
    assert got["a.txt"]["parser_used"] == "plain" and got["a.txt"]["blocks"][0]["doc_item_type"] == "heading" and "no" in got["b.txt"]["error"]


def test_embedder_is_unit_and_stable():
    e = adapters.HashingEmbedder(64)
    v = e.encode(["a b", "a b", ""])
    assert np.allclose(v[0], v[1]) and math.isclose(np.linalg.norm(v[0]), 1.0) and not v[2].any()


def test_parent_context(spark):
    rows = [(1, "s", 1, "A", None, "one"), (2, "s", 2, "A", None, "two"), (3, "t", 1, "A", None, "other"), (4, "s", 3, None, None, "loose")]
    c = spark.createDataFrame(rows, "key long, source_file string, seq long, level1 string, level2 string, content string")
    got = {r["key"]: (r["parent_context"], r["sibling_count"]) for r in search.parent_context(c.select("key"), c).collect()}
    assert got == {1: ("two", 2), 2: ("one", 2), 3: (None, None), 4: (None, None)}


@pytest.mark.parametrize("lengths", [(812, 799, 1287), (5, 800, 3), (801, 798, 2), (0, 799, 0, 4), (799, 799, 799)])
def test_parent_context_holds_the_blank_line_at_its_end(spark, lengths):
    """A first sibling of one character less than fits is followed by half of the blank line before the next."""
    texts = [chr(97 + i) * n for i, n in enumerate(lengths)]
    c = spark.createDataFrame([(i, "s", i, "A", None, t) for i, t in enumerate(texts)], "key long, source_file string, seq long, level1 string, level2 string, content string")
    got = {r["key"]: r["parent_context"] for r in search.parent_context(c.select("key"), c).collect()}
    assert got == {i: "\n\n".join(t for j, t in enumerate(texts) if j != i)[:800] for i in range(len(texts))}


def test_parent_context_passes_over_missing_texts(spark):
    c = spark.createDataFrame([(i, "s", i, "A", None, None if i < 500 else f"text {i}") for i in range(503)], "key long, source_file string, seq long, level1 string, level2 string, content string")
    got = {r["key"]: (r["parent_context"], r["sibling_count"]) for r in search.parent_context(c.select("key"), c).collect()}
    assert got[0] == ("text 500\n\ntext 501\n\ntext 502", 503) and got[501] == ("text 500\n\ntext 502", 503)

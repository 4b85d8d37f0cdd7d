"""What a task holds stays bounded: batches of models, folds, the best rows of searches; with plain versions beside it."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import adapters, chunking, metrics, search
from tessera.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


class Few(adapters.HashingEmbedder):
    """Refuses more than `most` texts at a time."""

    def __init__(self, most):
        super().__init__(32)
        self.most = most

    def encode(self, texts):
        assert len(texts) <= self.most
        return super().encode(texts)


def test_token_similarity_encodes_few_rows_at_a_time(spark):
    rows = [(" ".join(f"a{i}x{j}" for j in range(9)), " ".join(f"a{i}x{j}" for j in range(0, 18, 2))) for i in range(600)]
    score = adapters.token_similarity_udf(lambda: Few(20 * 18), batch=20)
    got = spark.createDataFrame(rows, "r string, a string").coalesce(1).select(score("r", "a").alias("s")).select("s.*").collect()
    wide = adapters.token_similarity_udf(lambda: Few(10**6), batch=10**6)
    want = spark.createDataFrame(rows, "r string, a string").coalesce(1).select(wide("r", "a").alias("s")).select("s.*").collect()
    assert np.allclose(got, want) and len(got) == 600


def plain_dense(rows, asked, k):
    """Pairs one by one; a missing score comes last, ties go to the smaller key."""

    def dot(a, b):
        return None if a is None or b is None or len(a) != len(b) or None in a or None in b else sum(x * y for x, y in zip(a, b, strict=True))

    out = set()
    for q, v in asked:
        scored = sorted(((dot(u, v), key) for key, u in rows), key=lambda x: (x[0] is None, -math.inf if x[0] is None else -round(x[0], 9), x[1]))
        out |= {(q, key, i + 1, None if score is None else round(score, 6)) for i, (score, key) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("names", [False, True])
def test_dense_pairs_are_never_rows(spark, names):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.integers(-2, 3, size=4)] for _ in range(300)]  # many ties
    vectors[5], vectors[6], vectors[7], vectors[8] = None, [1.0, None, 0.0, 1.0], [1.0, 2.0], []
    rows = [(f"k{i:03d}" if names else i, v) for i, v in enumerate(vectors)]
    asked = rows[:12] + rows[100:130]
    kind = "string" if names else "long"
    index, queries = spark.createDataFrame(rows, f"key {kind}, vec array<double>"), spark.createDataFrame(asked, f"query_id {kind}, qvec array<double>")
    for k, options in ((7, {}), (7, {"most": 700, "salts": 5}), (299, {}), (400, {})):
        found = search.search_dense(index, queries, k, **options)
        text = plan(found)
        assert "NestedLoopJoin" not in text and "CartesianProduct" not in text and "MergeJoin" not in text and "HashJoin" not in text
        got = {(r["query_id"], r["key"], r["rank"], None if r["score"] is None else round(r["score"], 6)) for r in found.collect()}
        assert got == plain_dense(rows, asked, k)
    assert search.search_dense(index, queries.limit(0), 3).count() == 0 and search.search_dense(index.limit(0), queries, 3).count() == 0


def test_similarity_stays_in_one_worker(spark, sf_dir):
    rows = [(f"one {i} text", f"text {i} two" if i % 3 else None) for i in range(100)]
    near = adapters.similarity_udf(lambda: Few(8), batch=8)
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(near("a", "b")).collect()]
    model = adapters.HashingEmbedder(32)
    assert got == pytest.approx([float(model.encode([a])[0] @ model.encode([b or ""])[0]) for a, b in rows])
    for name in ("semantic_quality", "answer_similarity", "faithfulness"):
        # one worker a task, which gives a number a row, not two that give vectors
        text = plan(catalog.QUERIES[name](spark, sf_dir))
        assert text.count("ArrowEvalPython") == 1, text


def test_embeddings_come_in_small_batches(spark):
    rows = [(i, f"text {i}" if i % 7 else None) for i in range(500)]
    embed = adapters.embedding_udf(lambda: Few(16), prefix="p ", batch=16)
    got = spark.createDataFrame(rows, "k long, t string").coalesce(1).select("k", embed("t").alias("v")).collect()
    model = adapters.HashingEmbedder(32)
    assert [r["k"] for r in got] == list(range(500)) and all(np.allclose(r["v"], model.encode([f"p {t or ''}"])[0]) for r, (_, t) in zip(got, rows, strict=True))


def test_chunks_of_many_sources_are_folded_without_a_call_each(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 211}", i // 211, rng.choice("AB"), rng.choice("hk"), f"text {i} " + "w " * rng.randint(0, 3), rng.choice([5, 39, 40, 80])) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source_file string, chunk_id long, level1 string, heading string, content string, word_count long").repartition(7)
    want = {}
    for s, _, one, h, t, n in sorted(rows):
        out = want.setdefault(s, [])
        if out and n < 40 and (out[-1][1] == h or out[-1][0] == one):
            out[-1][2] += "\n\n" + t
            out[-1][3] = len(out[-1][2].split())
        else:
            out.append([one, h, t, n])
    merged = chunking.merge_tiny(df)
    assert {(r["source_file"], r["chunk_id"]): [r["level1"], r["heading"], r["content"], r["word_count"]] for r in merged.collect()} == {(s, i + 1): x for s, l in want.items() for i, x in enumerate(l)}
    stitched = chunking.stitch(df.select("source_file", "chunk_id", "level1", F.lit(None).cast("string").alias("level2"), F.lit(None).cast("string").alias("level3"), "heading", "content", F.lit(None).cast("int").alias("page_start"), F.lit(1).alias("page_end"), "word_count"))
    assert all("InPandas" not in plan(x) for x in (merged, stitched))
    assert sum(len(r["repair_actions"]) + 1 for r in stitched.collect()) == 2000 and {r["page_start"] for r in stitched.collect()} == {None}


def test_words_of_an_answer_are_split_once(spark):
    rows = [("a b a c", "b a x"), ("", "x"), (None, None), ("Same  words", "words SAME same"), ("x", "y")]
    df = spark.createDataFrame(rows, "p string, t string")
    got = df.select(metrics.token_f1(F.col("p"), F.col("t")).alias("f"), *[metrics.distinct_n(F.col("t"), n).alias(f"d{n}") for n in (1, 2, 3)])
    for r, (p, t) in zip(got.collect(), rows, strict=True):
        a, b, w = set((p or "").lower().split()), set((t or "").lower().split()), (t or "").lower().split()
        grams = [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for n in (1, 2, 3)]
        assert list(r) == pytest.approx([2 * len(a & b) / (len(a) + len(b)) if a & b else 0.0, *(len(set(g)) / len(g) if g else 0.0 for g in grams)])
    for n in (1, 2):
        text = df.select(metrics.distinct_n(F.col("t"), n).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("split(") == 1, text


def plain_bm25(docs, asked, k, kept=lambda lang: True, k1=1.5, b=0.75, epsilon=0.25):
    """By the formula, over every question and document; documents of one key count as one, those without a key are no result."""
    from tessera.functions.tokens import STOP_WORDS

    toks = [(key, lang, [w for w in (t or "").lower().split() if len(w) > 1 and w not in STOP_WORDS]) for key, t, lang in docs]
    n, avg = len(toks), sum(len(t) for _, _, t in toks) / len(toks)
    df = Counter(w for _, _, t in toks for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean, out = sum(raw.values()) / len(raw), set()
    keys = {key for key, lang, _ in toks if key is not None and kept(lang)}
    tf = Counter((key, len(t), w) for key, _, t in toks for w in t if key in keys)
    for q, text in asked:
        want = Counter(w for w in (text or "").lower().split() if w in raw)
        score = Counter()
        for (key, dl, w), c in tf.items():
            if w in want:
                score[key] += want[w] * (raw[w] if raw[w] >= 0 else epsilon * mean) * c * (k1 + 1) / (c + k1 * (1 - b + b * dl / avg))
        best = sorted(((-round(s, 9), key, s) for key, s in score.items() if s > 0))[:k]
        out |= {(q, key, i + 1, round(s, 6)) for i, (_, key, s) in enumerate(best)}
    return out


@pytest.mark.parametrize("case", ["plain", "again", "names", "filtered", "filtered again"])
def test_sparse_scores_are_never_dealt_out(spark, case):
    rng = random.Random(case)
    words = [f"word{i}" for i in range(40)] + ["the"]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(41)], k=n))
    docs = [(i, text(rng.randint(0, 60)), rng.choice("ab")) for i in range(400)]
    docs += [(1000 + i, docs[i % 3][1], "a") for i in range(60)] + [(5000, None, "b"), (None, text(9), "a")]  # copies tie
    if "again" in case:
        docs += [(i, docs[i][1], "b") for i in range(0, 90, 7)] + [(i, text(30), "a") for i in range(1, 80, 7)]
    asked = [(i, text(rng.randint(1, 12))) for i in range(50)] + [(70, docs[0][1]), (71, "unknown words"), (72, None)]
    kind = "string" if case == "names" else "long"
    if case == "names":
        docs = [(None if k is None else f"d{k:04d}", t, x) for k, t, x in docs]
    d = spark.createDataFrame(docs, f"doc_id {kind}, text string, lang string").repartition(6)
    q = spark.createDataFrame(asked, "item_id long, text string")
    kept, filters = ((lambda x: x == "a"), {"lang": ["a"]}) if "filtered" in case else ((lambda x: True), None)
    for k, options in ((5, {}), (5, {"most": 60}), (500, {})):
        found = search.search_sparse(d, q, k, filters=filters, **options)
        if "again" not in case:
            # the only rows that are dealt out are the best of each task
            assert plan(found).count("Exchange hashpartitioning") == 1 and "Join" not in plan(found), plan(found)
        got = {(r["query_id"], r["key"], r["rank"], round(r["score"], 6)) for r in found.collect()}
        assert got == plain_bm25(docs, asked, k, kept)
    assert search.search_sparse(d, q.limit(0), 5).count() == 0 and search.search_sparse(d.limit(0), q, 5).count() == 0


def test_best_rows_take_no_more_than_their_share():
    from tessera.operators import best

    got, rng, seen = best.Best(20, 30), np.random.default_rng(2), []
    for i in range(60):
        scores = np.round(rng.normal(size=(20, 500)), 2) if i % 9 else np.zeros((20, 500))
        keys = rng.permutation(500) + i * 500
        got.add(0, scores, keys)
        seen += [(scores, keys)]
        assert got.held <= 2 * 20 * 30 + best.CELLS // 4 + 20 * 500
    got.prune()
    scores, keys = np.concatenate([s for s, _ in seen], 1), np.concatenate([k for _, k in seen])
    q, _, found, _ = got.parts[0]
    for j in range(20):
        assert found[q == j].tolist() == keys[np.lexsort((keys, -scores[j]))][:30].tolist()

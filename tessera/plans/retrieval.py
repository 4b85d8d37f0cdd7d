"""Queries of sparse and dense search, fusion, context and routing.

The benchmark's texts are the questions and the documents the chunks. Where dense and sparse results meet, a
document is paired with the vector of the same number; that pairing is synthetic.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import Search
from tessera.functions import tokens as K
from tessera.operators import search
from tessera.plans.common import PLAIN, STEMMED, WINDOWS, table, windows

S6 = lambda c: F.round(c, 6).alias(c)


def bm25_topk(spark, sf_dir):
    got = search.search_sparse(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return got.select("query_id", F.col("key").alias("doc_id"), S6("score"), "rank")


def bm25_filtered(spark, sf_dir):
    got = search.search_sparse(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, filters={"lang": ["en", "fr"]})
    return got.select("query_id", F.col("key").alias("doc_id"), S6("score"), "rank")


def bm25_stemmed(spark, sf_dir):
    got = search.search_sparse(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, tokenizer="stemmed")
    return got.select("query_id", F.col("key").alias("doc_id"), S6("score"), "rank")


def term_statistics(spark, sf_dir):
    i = search.build_sparse(table(spark, sf_dir, "documents"))
    return i["terms"].select("term", "df", F.round("raw_idf", 6).alias("idf"))


def _dense(spark, sf_dir, dim):
    index = search.build_dense(table(spark, sf_dir, "embeddings"), dim=dim)
    return index, index.where("key % 50 = 0").select(F.col("key").alias("query_id"), F.col("vec").alias("qvec"))


def dense_topk(spark, sf_dir):
    return search.search_dense(*_dense(spark, sf_dir, 512), k=10).select("query_id", F.col("key").alias("vec_id"), S6("score"), "rank")


def dense_topk_dim32(spark, sf_dir):
    return search.search_dense(*_dense(spark, sf_dir, 32), k=10).select("query_id", F.col("key").alias("vec_id"), S6("score"), "rank")


def dense_filtered(spark, sf_dir):
    index, asked = _dense(spark, sf_dir, 64)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label")
    return search.search_dense(index.join(labels, "key"), asked, 10, F.col("label") == 1).select("query_id", F.col("key").alias("vec_id"), S6("score"), "rank")


def _both(spark, sf_dir, k=100):
    """Every question against the documents, and the vectors of their numbers against the vectors."""
    asked = table(spark, sf_dir, "benchmark")
    index, _ = _dense(spark, sf_dir, 64)
    vectors = index.join(asked.select(F.col("item_id").alias("key")), "key", "left_semi").select(F.col("key").alias("query_id"), F.col("vec").alias("qvec"))
    return search.search_sparse(table(spark, sf_dir, "documents"), asked, k), search.search_dense(index, vectors, k=k)


def rrf_fusion(spark, sf_dir):
    sparse, dense = _both(spark, sf_dir)
    return search.rrf(sparse, dense, 20).select("query_id", F.col("key").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


def minmax_fusion(spark, sf_dir):
    sparse, dense = _both(spark, sf_dir)
    rows = sparse.select("query_id", "key", F.col("score").alias("sparse")).join(dense.select("query_id", "key", F.col("score").alias("dense")), ["query_id", "key"], "full_outer")
    rows = rows.select("query_id", "key", F.coalesce("sparse", F.lit(0.0)).alias("sparse"), F.coalesce("dense", F.lit(0.0)).alias("dense"), (F.col("key") % 3).cast("double").alias("boost"))
    return search.score_fusion(rows, 20).select("query_id", F.col("key").alias("doc_id"), S6("score"), "rank")


def phrase_boost(spark, sf_dir):
    """The boost of each question's 50 best documents."""
    got = search.search_sparse(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)
    d, q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return got.join(d, "key").join(q, "query_id").select("query_id", F.col("key").alias("doc_id"), F.round(search.phrase_boost(F.col("q"), F.col("text"), ("thing", "ing")), 6).alias("boost"))


def rerank_overlap(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark")
    got = search.search_sparse(table(spark, sf_dir, "documents"), q, 20)
    best = search.rerank(got, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content")), q.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), search.overlap_score(F.col("question"), F.col("content")), 5)
    return best.select("query_id", F.col("key").alias("doc_id"), S6("score"), "rank")


def sibling_context(spark, sf_dir):
    c = windows(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("window")).alias("key"), F.col("doc_id").cast("string").alias("source_file"), F.col("window").alias("seq"), F.lit("part").alias("level1"), F.lit(None).cast("string").alias("level2"), "content")
    return search.parent_context(c.select("key"), c).select("key", F.md5("parent_context").alias("context_md5"), F.col("sibling_count"))


def context_budget(spark, sf_dir):
    got = search.search_sparse(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.length("text").alias("chars"))
    rows = got.join(d, "key").select(F.floor(F.col("query_id") / 4).alias("question_id"), (F.col("query_id") % 4).alias("sub_no"), "rank", "key", "chars")
    return search.budgeted(rows).select("question_id", "sub_no", "rank", F.col("key").alias("doc_id"), "chars")


def prompt_context(spark, sf_dir):
    """Whole texts of a question's three best documents; the budget of `assemble` is the only cut."""
    got = search.search_sparse(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 3)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("source_file"), F.col("text").alias("content"))
    return search.assemble(got.join(d, "key").withColumnRenamed("query_id", "question_id")).select("question_id", F.md5("prompt_context").alias("context_md5"))


RULES = [(1, ["thing", "onth"], 2), (2, ["ation"], 1), (3, ["der", "und", "ein"], 2)]


def rule_router(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule_id int, keywords array<string>, min_hits int")
    return search.route(table(spark, sf_dir, "benchmark"), rules).select("item_id", "rule_id")


def rank_probe(spark, sf_dir):
    got = search.search_sparse(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 2000)
    src = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source")
    return search.rank_of(got.join(src, "key"), F.col("source") == "src3")


_s = Search()


def _bm25(tok: str, where: str = "true") -> str:
    """CTEs up to s(query_id, doc_id, score, rank)."""
    return f"""d AS (SELECT doc_id, {tok.format('text')} AS t FROM documents), n AS (SELECT count(*) AS docs, avg(len(t)) AS avgdl FROM d),
    p AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY doc_id, len(t), term),
    f AS (SELECT term, count(*) AS df, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, n GROUP BY term, docs),
    i AS (SELECT term, df, raw, CASE WHEN raw < 0 THEN {_s.epsilon} * (SELECT avg(raw) FROM f) ELSE raw END AS idf FROM f),
    q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tok.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
    c AS (SELECT query_id, p.doc_id, sum(qtf * idf * tf * ({_s.k1} + 1) / (tf + {_s.k1} * (1 - {_s.b} + {_s.b} * dl / avgdl))) AS score FROM q JOIN i USING (term) JOIN p USING (term), n WHERE p.doc_id IN (SELECT doc_id FROM documents WHERE {where}) GROUP BY 1, 2),
    s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM c WHERE score > 0)"""


def _vec(dim: int, asked: str = "q.vec_id % 50 = 0") -> str:
    """CTEs up to dn(query_id, vec_id, score, rank)."""
    return f"""v0 AS (SELECT vec_id, label, list_transform(embedding[1:{dim}], lambda x: x::DOUBLE) AS e FROM embeddings), v AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda y: y * y))) + 1e-10)) AS e FROM v0),
    dd AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS score FROM v q, v WHERE {asked})"""


_RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM dd"
_BEST = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM s WHERE rank <= 10"
_TERMS = "list_distinct(list_filter({0}, lambda t: NOT list_contains([" + ", ".join(repr(w) for w in K.STOP_WORDS) + "], t)))"
_two = f"WITH {_bm25(PLAIN)}, {_vec(64, 'q.vec_id IN (SELECT item_id FROM benchmark)')}, dn AS ({_RANKED}), a AS (SELECT query_id, doc_id AS key, score AS ss, rank AS sr FROM s WHERE rank <= 100), b AS (SELECT query_id, vec_id AS key, score AS ds, rank AS dr FROM dn WHERE rank <= 100), "
_tq = STEMMED.format("question")

SQL = {
    "bm25_topk": f"WITH {_bm25(PLAIN)} {_BEST}",
    "bm25_filtered": f"WITH {_bm25(PLAIN, chr(108) + 'ang IN (' + repr('en') + ', ' + repr('fr') + ')')} {_BEST}",
    "bm25_stemmed": f"WITH {_bm25(STEMMED)} {_BEST}",
    "term_statistics": f"WITH {_bm25(PLAIN)} SELECT term, df, round(raw, 6) AS idf FROM f",
    "dense_topk": f"WITH {_vec(512)} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_RANKED}) WHERE rank <= 10",
    "dense_topk_dim32": f"WITH {_vec(32)} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_RANKED}) WHERE rank <= 10",
    "dense_filtered": f"WITH {_vec(64)} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_RANKED} WHERE label = 1) WHERE rank <= 10",
    "rrf_fusion": _two + "r AS (SELECT query_id, key, sr, dr, coalesce(0.4 / (60 + sr), 0) + coalesce(0.6 / (60 + dr), 0) AS score FROM a FULL JOIN b USING (query_id, key)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, sr NULLS LAST, dr NULLS LAST, key) AS rank FROM r) SELECT query_id, key AS doc_id, round(score, 9)::DOUBLE AS score, rank FROM o WHERE rank <= 20",
    "minmax_fusion": _two + "r AS (SELECT query_id, key, coalesce(ss, 0) AS s0, coalesce(ds, 0) AS d0, (key % 3)::DOUBLE AS b0 FROM a FULL JOIN b USING (query_id, key)), m AS (SELECT query_id, key, " + " + ".join(f"{w} * CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-9 THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END" for w, c in ((0.65, "d0"), (0.30, "s0"), (0.05, "b0"))) + " AS score FROM r WINDOW w AS (PARTITION BY query_id)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank FROM m) SELECT query_id, key AS doc_id, round(score, 6)::DOUBLE AS score, rank FROM o WHERE rank <= 20",
    "phrase_boost": f"WITH {_bm25(PLAIN)}, x AS (SELECT query_id, s.doc_id, lower(trim(b.text)) AS q, lower(d2.text) AS t, list_filter({STEMMED.format('b.text')}, lambda t: NOT list_contains([{', '.join(repr(w) for w in K.STOP_WORDS)}], t)) AS toks FROM s JOIN benchmark b ON b.item_id = query_id JOIN documents d2 ON d2.doc_id = s.doc_id WHERE rank <= 50) SELECT query_id, doc_id, round(CASE WHEN q <> '' AND contains(t, q) THEN 2 ELSE 0 END + 0.08 * len(list_filter(toks, lambda k: contains(t, k))) + 0.25 * len(list_filter(['thing', 'ing'], lambda k: list_contains(toks, k) AND contains(t, k))), 6)::DOUBLE AS boost FROM x",
    "rerank_overlap": f"WITH {_bm25(PLAIN)}, t AS (SELECT query_id, s.doc_id, {_TERMS.format(STEMMED.format('b.text'))} AS q, {_TERMS.format(STEMMED.format('d2.text'))} AS c FROM s JOIN benchmark b ON b.item_id = query_id JOIN documents d2 ON d2.doc_id = s.doc_id WHERE rank <= 20), x AS (SELECT query_id, doc_id, CASE WHEN len(q) > 0 THEN len(list_intersect(q, c)) / len(q) ELSE 0 END AS score FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x) SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, rank FROM o WHERE rank <= 5",
    "sibling_context": f"SELECT a.doc_id * 1000 + a.\"window\" AS key, md5(left(string_agg(b.content, chr(10) || chr(10) ORDER BY b.\"window\") FILTER (WHERE b.\"window\" <> a.\"window\"), 800)) AS context_md5, CASE WHEN count(*) > 1 THEN count(*) END AS sibling_count FROM {WINDOWS} a JOIN {WINDOWS} b USING (doc_id) GROUP BY a.doc_id, a.\"window\"",
    "prompt_context": f"WITH {_bm25(PLAIN)} SELECT query_id AS question_id, md5(left(string_agg('[Source: ' || upper(source[:1]) || source[2:] || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank), 8500)) AS context_md5 FROM s JOIN documents d2 ON d2.doc_id = s.doc_id WHERE rank <= 3 GROUP BY 1",
    "rule_router": "SELECT item_id, CASE " + " ".join("WHEN len(list_filter([{}], lambda k: contains(lower(text), k))) >= {} THEN {}".format(", ".join(repr(k) for k in ks), n, r) for r, ks, n in RULES) + " END AS rule_id FROM benchmark",
    "rank_probe": f"WITH {_bm25(PLAIN)} SELECT query_id, min(rank) AS rank FROM s JOIN documents d2 ON d2.doc_id = s.doc_id WHERE source = 'src3' AND rank <= 2000 GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_filtered, bm25_stemmed, term_statistics, dense_topk, dense_topk_dim32, dense_filtered, rrf_fusion, minmax_fusion, phrase_boost, rerank_overlap, sibling_context, context_budget, prompt_context, rule_router, rank_probe)}

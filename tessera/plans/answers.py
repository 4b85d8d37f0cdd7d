"""Queries of retrieval as a whole, of model-backed measures by offline stand-ins, and of block filters.

Questions are the benchmark's texts. Where a model would answer, a column expression or a stand-in does; what it says
is no measure of a model, only of what is done with an answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions import text as T
from tessera.operators import adapters, layout, metrics, relational, retrieval, search, validation
from tessera.operators.retrieval import Corpus, Mode
from tessera.plans.common import COUNT, FIRSTS, LINES, PLAIN, STEMMED, STRIP, WORDS, firsts, lines, table
from tessera.plans.evaluation import _pairs
from tessera.plans.retrieval import _RANKED, _TERMS, _bm25, _vec
from tessera.streaming import ingest

R6 = lambda c: F.round(c, 6).alias(c)


def _corpus(spark, sf_dir):
    """Documents as chunks of their source; each with the vector of the same number, which is synthetic."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("key"), F.col("source").alias("source_file"), F.col("doc_id").alias("seq"), F.col("lang").alias("level1"), F.lit(None).cast("string").alias("level2"), F.col("text").alias("content"), "lang")
    return Corpus(chunks, search.build_dense(table(spark, sf_dir, "embeddings"), dim=64))


def _asked(spark, sf_dir):
    """(query_id, question, qvec): questions with a vector of their number."""
    v = search.build_dense(table(spark, sf_dir, "embeddings"), dim=64).select(F.col("key").alias("query_id"), F.col("vec").alias("qvec"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")).join(v, "query_id")


def search_modes(spark, sf_dir):
    """The ten best of each question by either side and by both."""
    corpus, asked, out = _corpus(spark, sf_dir), _asked(spark, sf_dir), None
    for kind in ("bm25", "embedding", "hybrid"):
        one = retrieval.search(corpus, asked, Mode(kind, 10, None, False)).select(F.lit(kind).alias("mode"), "query_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")
        out = one if out is None else out.unionByName(one)
    return out


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _subs(questions):
    """The question and its halves, as a model's answer would list them."""
    w = T.words(F.col("question"))
    half = F.floor(F.size(w) / 2).cast("int")
    parts = F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))
    return retrieval.decompose(questions, F.concat(F.lit("Here they are: "), F.to_json(parts), F.lit(" as asked.")))


def sub_queries(spark, sf_dir):
    return _subs(_questions(spark, sf_dir)).select("question_id", "sub_no", F.md5("sub_query").alias("query_md5"))


SPARSE = Mode("bm25", 20, 3, False)
OVERLAP = search.overlap_score


def multi_query_context(spark, sf_dir):
    got = retrieval.retrieve(_corpus(spark, sf_dir), _subs(_questions(spark, sf_dir)), SPARSE, OVERLAP)
    return got.select("question_id", "sub_no", "rank", F.col("key").alias("doc_id"), "chars")


def unreranked_first_two(spark, sf_dir):
    got = retrieval.retrieve_plain(_corpus(spark, sf_dir), _subs(_questions(spark, sf_dir)), Mode("bm25", 5, None, False))
    return got.select("question_id", "place", "sub_no", "rank", F.col("key").alias("doc_id"))


def verified_context(spark, sf_dir):
    """Questions of an odd length whose first search found something are refused, and asked again by their first half."""
    corpus, questions = _corpus(spark, sf_dir), _questions(spark, sf_dir)
    w = T.words(F.col("question"))
    half = F.array_join(F.slice(w, F.lit(1), F.floor(F.size(w) / 2).cast("int")), " ")
    verdict = F.to_json(F.struct((F.length("question") % 2 == 0).alias("relevant"), F.array(half).alias("refined_queries")))
    find = lambda subs: retrieval.retrieve(corpus, subs, SPARSE, OVERLAP)
    first = find(retrieval.decompose(questions, None))
    got = retrieval.verify(first, questions, lambda question, previews: F.concat(F.lit("Verdict: "), verdict), find)
    return got.select("question_id", "sub_no", "rank", F.col("key").alias("doc_id"), "chars")


def mean_search_score(spark, sf_dir):
    got = retrieval.retrieve(_corpus(spark, sf_dir), retrieval.decompose(_questions(spark, sf_dir), None), Mode("bm25", 10, None, False), budget=1 << 40)
    return retrieval.mean_score(got).select("question_id", R6("mean_score"))


def context_windows(spark, sf_dir):
    """How many of a question's terms its context has, for three budgets."""
    questions = _questions(spark, sf_dir)
    got = retrieval.retrieve(_corpus(spark, sf_dir), retrieval.decompose(questions, None), Mode("bm25", 5, None, False), budget=1 << 40)
    return retrieval.window_sweep(got, questions, (500, 2000, 8000), lambda part, question: search.overlap_score(question, part)).select("size", "question_id", "chars", R6("value"))


def pair_rerank(spark, sf_dir):
    """The 20 best documents of each question by a pair scorer that runs in batches."""
    score = adapters.pair_udf(adapters.OverlapScorer)
    got = retrieval.search(_corpus(spark, sf_dir), _asked(spark, sf_dir).drop("qvec"), Mode("bm25", 20, 5, False), score)
    return got.select("query_id", F.col("key").alias("doc_id"), R6("score"), "rank")


def generated_answers(spark, sf_dir):
    """The whole way with stand-ins: halves from a generator, contexts with the texts around, a draft and its audit."""
    questions = _questions(spark, sf_dir)
    subs = retrieval.decompose(questions, adapters.generation_udf(adapters.ClauseSplitter)(F.col("question")))
    got = retrieval.retrieve(_corpus(spark, sf_dir), subs, Mode("bm25", 10, 2, True), OVERLAP)
    return retrieval.answers(retrieval.prompts(got, questions), adapters.generation_udf(adapters.ExtractiveGenerator))


def _near(a, b):
    return adapters.similarity_udf(adapters.HashingEmbedder)(a, b)


def answer_similarity(spark, sf_dir):
    """Cosine of each assistant turn and the turn before it."""
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(_near(F.col("prompt"), F.col("text")), 6).alias("similarity"))


def token_similarity(spark, sf_dir):
    score = adapters.token_similarity_udf(adapters.HashingEmbedder)
    return _pairs(spark, sf_dir).select("conv_id", "turn", score(F.col("prompt"), F.col("text")).alias("s")).select("conv_id", "turn", *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


def faithfulness(spark, sf_dir):
    """The share of an answer's sentences that are near the turn before, of which the first 3000 characters count."""
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", metrics.answer_sentences(F.col("text")).alias("s"), F.left("prompt", F.lit(3000)).alias("context"))
    each = rows.select("conv_id", "turn", "context", F.explode_outer("s").alias("sentence"))
    near = each.withColumn("near", F.when(F.col("sentence").isNotNull(), _near(F.coalesce("sentence", F.lit("")), F.col("context"))))
    per = near.groupBy("conv_id", "turn").agg(F.collect_list(F.when(F.col("sentence").isNotNull(), F.struct("sentence", "near"))).alias("l"))
    share = metrics.faithfulness(F.transform("l", lambda x: x["sentence"]), F.transform("l", lambda x: x["near"]))
    return per.select("conv_id", "turn", F.round(share, 6).alias("faithfulness"))


def semantic_quality(spark, sf_dir):
    """Chunks judged with the cosine of heading and content."""
    d = firsts(spark, sf_dir).withColumn("near", _near(F.col("heading"), F.col("content")))
    d = d.select(F.col("doc_id").alias("chunk_id"), "heading", "content", "near", *[F.lit(None).cast("string").alias(f"level{k}") for k in (1, 2, 3)])
    judged = validation.validate(d, F.col("near"))
    return judged.select("chunk_id", F.round("quality.semantic", 6).alias("semantic"), F.exists("issues", lambda x: x["code"] == "S001").alias("apart"))


def zipped_rows(spark, sf_dir):
    """Each document beside the label of the same place in its order."""
    d = table(spark, sf_dir, "documents").select(F.lit(1).alias("g"), F.col("lang"), "doc_id")
    lab = table(spark, sf_dir, "labels").select(F.lit(1).alias("g"), "doc_id", "quality")
    return relational.zipped(d, lab, ["g"], ["doc_id"], "left").select("doc_id", "lang", "quality")


def _placed(spark, sf_dir):
    """Lines as blocks with made-up places and sizes."""
    at = F.col("seq") % 40
    size = (10 + F.length("line") % 11).cast("double")
    return lines(spark, sf_dir).select("doc_id", "source", "seq", "line", (at * 20).cast("double").alias("y"), (F.length("line") % 5 * 100).cast("double").alias("x"), size.alias("size"), F.when(F.col("seq") % 7 == 0, F.array(F.lit("Wingdings"))).otherwise(F.array(F.lit("Serif"))).alias("fonts"))


def block_filters(spark, sf_dir):
    """How many lines each block filter holds for, by source."""
    b, t = _placed(spark, sf_dir), F.col("line")
    margin, visual = P.in_margin(F.col("y"), F.col("y") + 12, 40.0, 740.0), P.is_visual_noise(t, F.col("fonts"), F.col("size"), F.col("x"))
    keeps = P.keeps_block(t, margin, visual, P.is_bibliography(t), ("share with us.",))
    flags = {
        "margin": margin, "visual": visual, "page_noise": P.is_page_noise(t, F.col("y"), F.col("y") + 12, F.col("size"), boilerplate=("the ",)), "kept": keeps,
        "lead_in": P.is_lead_in(keeps, F.col("size")), "long_enough": P.is_long_enough(t, F.floor(F.col("seq") / 40)), "heading": layout.is_heading_block(t, F.col("size"), F.lit(11.0)),
    }
    return b.groupBy("source").agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in flags.items()])


def paragraph_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("long").alias("n"))


CRUMBS = [(1, "Home » Part » Chapter", "Chapter"), (2, "Home > Part", "Deep"), (3, "Home » A » B » C", "D"), (4, "", "Alone"), (5, None, "Alone"), (6, " » Part » ", "part")]


def breadcrumb_levels(spark, sf_dir):
    df = spark.createDataFrame(CRUMBS, "id int, crumb string, heading string")
    levels = layout.levels_from_breadcrumb(T.breadcrumb(F.col("crumb"), "»>"), F.col("heading"))
    return df.select("id", *[x.alias(f"level{k}") for k, x in enumerate(levels, 1)])


def filled_fields(spark, sf_dir):
    """The first field that isn't blank, and whether it is a list of references."""
    d = firsts(spark, sf_dir).withColumn("blank", F.lit(" "))
    first = P.first_filled("blank", "heading", "content")
    return d.select("doc_id", F.md5(first).alias("first_md5"), P.is_references(first).alias("references"))


def pending_items(spark, sf_dir):
    """Documents without a label, in order of the number in their names."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("name"))
    open_ = ingest.pending(d, table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return relational.by_number_suffix(open_, "name").select("name")


_HALF = "array_to_string(w[:len(w) // 2], ' ')"
_SUBS = f"(SELECT question_id, sub_no, sub_query FROM (SELECT item_id AS question_id, unnest(l) AS sub_query, generate_subscripts(l, 1) - 1 AS sub_no FROM (SELECT item_id, [text] || CASE WHEN a <> '' AND a <> text THEN [a] ELSE [] END || CASE WHEN b <> '' AND b <> text AND b <> a THEN [b] ELSE [] END AS l FROM (SELECT item_id, text, {_HALF} AS a, array_to_string(w[len(w) // 2 + 1:], ' ') AS b FROM (SELECT item_id, text, {WORDS.format('text')} AS w FROM benchmark)))))"


def _found(subs: str, k: int) -> str:
    """CTEs up to s(question_id, sub_no, doc_id, score, rank): sub-queries searched."""
    inner = _bm25(PLAIN).replace("FROM benchmark)", f"FROM (SELECT question_id || '#' || sub_no AS item_id, sub_query AS text FROM {subs}))")
    return inner + f", ss AS (SELECT q.question_id, q.sub_no, q.sub_query, s.doc_id, s.score, s.rank FROM s JOIN {subs} q ON q.question_id || '#' || q.sub_no = s.query_id WHERE rank <= {k})"


def _budget(subs: str) -> str:
    """CTEs up to kept(question_id, sub_no, rank, doc_id, chars): found, reranked by shared terms, within the budget."""
    return f"""{_found(subs, 20)}, t AS (SELECT question_id, sub_no, ss.doc_id, {_TERMS.format(STEMMED.format('sub_query'))} AS q, {_TERMS.format(STEMMED.format('d2.text'))} AS c, len(d2.text) AS chars FROM ss JOIN documents d2 USING (doc_id)),
    x AS (SELECT *, row_number() OVER (PARTITION BY question_id, sub_no ORDER BY round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, c)) / len(q) ELSE 0 END, 9) DESC, doc_id) AS rank FROM t),
    {_FOLD.format(rows="(SELECT question_id, sub_no, rank, doc_id, chars FROM x WHERE rank <= 3)")}"""


#: A question's rows one after the other, each first found one against what is left of the budget.
_FOLD = """yo AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sub_no, rank) AS n FROM (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY sub_no, rank) = 1)),
    fo AS (SELECT question_id, n, sub_no, rank, doc_id, chars, chars <= 8500 AS ok, CASE WHEN chars <= 8500 THEN chars ELSE 0 END AS used, CASE WHEN chars <= 8500 THEN -1 ELSE sub_no END AS over FROM yo WHERE n = 1
        UNION ALL SELECT yo.question_id, yo.n, yo.sub_no, yo.rank, yo.doc_id, yo.chars, fo.over <> yo.sub_no AND used + yo.chars <= 8500, used + CASE WHEN fo.over <> yo.sub_no AND used + yo.chars <= 8500 THEN yo.chars ELSE 0 END, CASE WHEN fo.over <> yo.sub_no AND used + yo.chars > 8500 THEN yo.sub_no ELSE fo.over END FROM fo JOIN yo ON yo.question_id = fo.question_id AND yo.n = fo.n + 1),
    kept AS (SELECT question_id, sub_no, rank, doc_id, chars FROM fo WHERE ok)"""

_ONE = "(SELECT item_id AS question_id, 0 AS sub_no, text AS sub_query FROM benchmark)"
_TWICE = f"(SELECT item_id * 2 AS question_id, 0 AS sub_no, text AS sub_query FROM benchmark UNION ALL SELECT item_id * 2 + 1, 0, a FROM (SELECT item_id, text, {_HALF} AS a FROM (SELECT item_id, text, {WORDS.format('text')} AS w FROM benchmark)) WHERE len(text) % 2 = 1 AND a <> '')"
_VEC = _vec(64, "q.vec_id IN (SELECT item_id FROM benchmark)")
_PROMPTS = "(SELECT question_id, left(string_agg('[Source: ' || upper(source[:1]) || source[2:] || ']' || chr(10) || d2.text, chr(10) || chr(10) ORDER BY rank), 8000) AS c FROM ss JOIN documents d2 USING (doc_id) GROUP BY 1)"
_T = lambda c: _TERMS.format(STEMMED.format(c))
_BLOCKS = f"(SELECT *, (seq % 40) * 20.0 AS y, (len(line) % 5) * 100.0 AS x, 10.0 + len(line) % 11 AS size, {COUNT.format('line')} AS n FROM {LINES})"
_N = lambda pattern: f"len(regexp_extract_all(line, '{pattern}'))"
_YEARS = _N(r"\b(?:19\d{2}|20[0-2]\d)\b")
_BIB = f"(n >= 3 AND (({_YEARS} >= 2 AND {_N(r'(?i)\b(?:J Clin|N Engl J Med|Lancet|JAMA|BMJ|guideline|guidelines)\b')} >= 1) OR ({_YEARS} >= 1 AND {_N(r'(?i)\b(?:et al\.|pp\.|vol\.|journal|clinical trial|recommendation|consensus)\b')} >= 2)))"
_MARGIN = "(y + 12 < 40 OR y > 740)"
_VISUAL = f"((seq % 7 = 0 AND n <= 12) OR (size >= 13.5 AND n <= 20) OR (size >= 15 AND x > 300) OR contains(line, 'http') OR {_N(r'\.org')} + {_N(r'\.gov')} >= 2 OR (n <= 8 AND x > 300))"
_KEPT = f"(line <> '' AND line <> 'share with us.' AND NOT {_MARGIN} AND NOT {_VISUAL} AND NOT {_BIB})"

SQL = {
    "search_modes": f"WITH {_bm25(PLAIN)}, {_VEC}, dn AS ({_RANKED}), asked AS (SELECT item_id FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)), a AS (SELECT query_id, doc_id AS key, score AS ss, rank AS sr FROM s WHERE rank <= 10 AND query_id IN (FROM asked)), b AS (SELECT query_id, vec_id AS key, score AS ds, rank AS dr FROM dn WHERE rank <= 10), r AS (SELECT query_id, key, sr, dr, coalesce(0.4 / (60 + sr), 0) + coalesce(0.6 / (60 + dr), 0) AS score FROM a FULL JOIN b USING (query_id, key)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, sr NULLS LAST, dr NULLS LAST, key) AS rank FROM r) SELECT 'bm25' AS mode, query_id, key AS doc_id, round(ss, 6)::DOUBLE AS score, sr AS rank FROM a UNION ALL SELECT 'embedding', query_id, key, round(ds, 6)::DOUBLE, dr FROM b UNION ALL SELECT 'hybrid', query_id, key, round(score, 6)::DOUBLE, rank FROM o WHERE rank <= 10",
    "sub_queries": f"SELECT question_id, sub_no, md5(sub_query) AS query_md5 FROM {_SUBS}",
    "multi_query_context": f"WITH RECURSIVE {_budget(_SUBS)} SELECT * FROM kept",
    "unreranked_first_two": f"WITH {_found(_SUBS, 5)}, o AS (SELECT question_id, sub_no, rank, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY sub_no, rank, doc_id) AS place FROM (SELECT * FROM ss QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY sub_no, rank) = 1)) SELECT question_id, place, sub_no, rank, doc_id FROM o WHERE place <= 2",
    "verified_context": f"WITH RECURSIVE {_budget(_TWICE)} SELECT question_id // 2 AS question_id, sub_no, rank, doc_id, chars FROM kept WHERE CASE WHEN question_id % 2 = 1 THEN question_id - 1 IN (SELECT question_id FROM kept) ELSE question_id + 1 NOT IN (SELECT question_id FROM kept) END",
    "mean_search_score": f"WITH {_bm25(PLAIN)} SELECT query_id AS question_id, round(avg(score), 6)::DOUBLE AS mean_score FROM s WHERE rank <= 10 GROUP BY 1",
    "context_windows": f"WITH {_found(_ONE, 5)}, pr AS (SELECT item_id, text, coalesce(c, '') AS c FROM benchmark LEFT JOIN {_PROMPTS} ON question_id = item_id), wi AS (SELECT size, item_id, {_T('text')} AS q, left(c, size) AS part FROM pr, (VALUES (500), (2000), (8000)) v(size)) SELECT size, item_id AS question_id, len(part) AS chars, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, {_T('part')})) / len(q) ELSE 0 END, 6)::DOUBLE AS value FROM wi",
    "pair_rerank": f"WITH {_bm25(PLAIN)}, t AS (SELECT query_id, s.doc_id, list_distinct({WORDS.format('lower(b.text)')}) AS q, list_distinct({WORDS.format('lower(d2.text)')}) AS c FROM s JOIN benchmark b ON b.item_id = query_id JOIN documents d2 ON d2.doc_id = s.doc_id WHERE rank <= 20 AND query_id IN (SELECT vec_id FROM embeddings)), x AS (SELECT query_id, doc_id, CASE WHEN len(q) > 0 THEN len(list_intersect(q, c)) / len(q) ELSE 0 END AS score FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x) SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, rank FROM o WHERE rank <= 5",
    "context_budget": f"WITH RECURSIVE {_bm25(PLAIN)}, {_FOLD.format(rows='(SELECT query_id // 4 AS question_id, query_id % 4 AS sub_no, rank, doc_id, len(d2.text) AS chars FROM s JOIN documents d2 USING (doc_id) WHERE rank <= 10)')} SELECT * FROM kept",
    "zipped_rows": "SELECT d.doc_id, lang, quality FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents) d LEFT JOIN (SELECT quality, row_number() OVER (ORDER BY doc_id) AS n FROM labels) USING (n)",
    "block_filters": f"SELECT source, count(*) FILTER (WHERE {_MARGIN}) AS margin, count(*) FILTER (WHERE {_VISUAL}) AS visual, count(*) FILTER (WHERE (y < 40 AND regexp_full_match(line, '\\d{{4}}')) OR y + 12 > 762 OR regexp_full_match(line, '\\d+') OR (contains(line, 'the ') AND size < 16)) AS page_noise, count(*) FILTER (WHERE {_KEPT}) AS kept, count(*) FILTER (WHERE {_KEPT} AND size >= 12.5 AND size < 19) AS lead_in, count(*) FILTER (WHERE len(line) >= 80 AND seq // 40 <> 0) AS long_enough, count(*) FILTER (WHERE n BETWEEN 1 AND 14 AND NOT regexp_matches(line, '[»>]') AND NOT (regexp_matches(line, '[.!?]\\z') AND size <= 12) AND size >= 11 * 1.18 AND NOT regexp_full_match(line, '[“”\"''`-]+')) AS heading FROM {_BLOCKS} GROUP BY source",
    "paragraph_counts": f"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {STRIP.format('x')}), lambda x: x <> '')) AS n FROM documents",
    "breadcrumb_levels": "SELECT * FROM (VALUES (1, 'Home', 'Part', 'Chapter'), (2, 'Home', 'Part', 'Deep'), (3, 'Home', 'A', 'B'), (4, 'Alone', NULL, NULL), (5, 'Alone', NULL, NULL), (6, 'Part', 'part', NULL)) v(id, level1, level2, level3)",
    "filled_fields": f"SELECT doc_id, md5(f) AS first_md5, coalesce(contains(upper(f), 'REFERENCES'), false) AS \"references\" FROM (SELECT doc_id, CASE WHEN {STRIP.format('heading')} <> '' THEN heading WHEN {STRIP.format('content')} <> '' THEN content END AS f FROM {FIRSTS})",
    "pending_items": "SELECT 'q' || doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}

QUERIES = {f.__name__: f for f in (search_modes, sub_queries, multi_query_context, unreranked_first_two, verified_context, mean_search_score, context_windows, pair_rerank, generated_answers, answer_similarity, token_similarity, faithfulness, semantic_quality, zipped_rows, block_filters, paragraph_counts, breadcrumb_levels, filled_fields, pending_items)}

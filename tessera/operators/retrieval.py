"""Retrieval as a whole: one search with modes, sub-queries, a budgeted context, its verification, and answers.

Models are column functions of the caller's (`adapters`): a scorer of (question, content) pairs, a generator of
texts, an embedder. Every step works on all questions at once; a question's own loop (search, judge, search again) is
two searches and a union.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import Search
from tessera.functions import predicates as P
from tessera.functions import text as T
from tessera.operators import search as S
from tessera.shared import cut

Scorer = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Corpus:
    """chunks: (key, source_file, seq, level1, level2, content, ..); vectors: (key, vec) of unit length, where there are dense searches;
    embed: makes such a vector of a question's text, where questions bring none (qvec)."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    embed: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Mode:
    """How to search. kind: bm25, embedding or hybrid; k: rows found; top: rows kept by the scorer; parents: with the texts around."""

    kind: str = "hybrid"
    k: int = 40
    top: int | None = 3
    parents: bool = True
    tokenizer: str = "plain"
    options: Search = Search()


#: Fixed combinations: the whole way, either side alone with its scorer, plain dense answers, plain sparse ones.
PRESETS = {
    "full": Mode(),
    "sparse_reranked": Mode("bm25", 20, 5, False),
    "dense_reranked": Mode("embedding", 20, 5, False),
    "dense_only": Mode("embedding", 5, None, False),
    "sparse_only": Mode("bm25", 5, None, False),
}


def search(corpus: Corpus, queries: DataFrame, mode: Mode = Mode(), scorer: Scorer | None = None, filters: dict[str, Any] | None = None) -> DataFrame:
    """(query_id, key, score, rank[, parent_context, sibling_count]) for queries (query_id, question[, qvec])."""
    chunks, s = corpus.chunks, mode.options
    sparse = dense = None
    if mode.kind in ("bm25", "hybrid"):
        sparse = S.search_sparse(chunks, queries, mode.k, s, filters, "key", "content", "query_id", "question", mode.tokenizer)
    if mode.kind in ("embedding", "hybrid"):
        asked = queries if "qvec" in queries.columns else queries.withColumn("qvec", corpus.embed(F.col("question"))).withColumn("qvec", S.unit(F.col("qvec")))
        index = corpus.vectors if filters is None else corpus.vectors.join(chunks.where(P.metadata(filters)).select("key"), "key", "left_semi")
        dense = S.search_dense(index, asked.select("query_id", "qvec"), mode.k)
    if sparse is None and dense is None:
        raise ValueError(f"no search of kind {mode.kind!r}")
    found = S.rrf(sparse, dense, mode.k, s) if sparse is not None and dense is not None else sparse if dense is None else dense
    if mode.top is not None:
        if scorer is None:
            found = found.where(F.col("rank") <= mode.top)
        else:
            found = S.rerank(found, chunks.select("key", "content"), queries.select("query_id", "question"), scorer(F.col("question"), F.col("content")), mode.top)
    found = found.select("query_id", "key", "score", "rank")
    return S.parent_context(found, chunks, s) if mode.parents else found


def decompose(questions: DataFrame, answer: Column | None) -> DataFrame:
    """(question_id, sub_no, sub_query): the question itself as number 0, then what a model's answer lists as a JSON array.

    An answer that holds no array of texts adds nothing; blank and repeated sub-queries go. answer: a column over `questions`
    (question_id, question), or null.
    """
    listed = F.coalesce(T.json_span(answer, "array<string>"), F.array().cast("array<string>")) if answer is not None else F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.array("question"), F.filter(listed, lambda x: T.strip(x) != "")))
    return questions.select("question_id", F.posexplode(every).alias("sub_no", "sub_query")).withColumn("sub_no", F.col("sub_no").cast("long"))


def _asked(subs: DataFrame) -> DataFrame:
    extra = [c for c in subs.columns if c == "qvec"]
    return subs.select(F.concat_ws("#", "question_id", "sub_no").alias("query_id"), F.col("sub_query").alias("question"), *extra)


def retrieve(corpus: Corpus, subs: DataFrame, mode: Mode = Mode(), scorer: Scorer | None = None, filters: dict[str, Any] | None = None, budget: int = 8500) -> DataFrame:
    """(question_id, sub_no, rank, key, chars, content, source_file, score, parent_context): each question's context within its budget of characters.

    Every sub-query is searched by itself; of a chunk that several find the first one's counts; chunks take their own length and
    that of the texts around them from the budget (see `budgeted`).
    """
    ids = subs.select("question_id", "sub_no", F.concat_ws("#", "question_id", "sub_no").alias("query_id"))
    # a few rows a sub-query, which are asked for several times below
    found = cut(search(corpus, _asked(subs), mode, scorer, filters).join(ids, "query_id").drop("query_id"))
    found = found if "parent_context" in found.columns else found.withColumn("parent_context", F.lit(None).cast("string"))
    full = found.join(corpus.chunks.select("key", "content", "source_file"), "key")
    full = full.withColumn("chars", (F.length(F.coalesce("content", F.lit(""))) + F.length(F.coalesce("parent_context", F.lit("")))).cast("long"))
    kept = S.budgeted(full.select("question_id", "sub_no", "rank", "key", "chars"), budget).select("question_id", "sub_no", "key")
    return full.join(kept, ["question_id", "sub_no", "key"]).select("question_id", "sub_no", "rank", "key", "chars", "content", "source_file", "score", "parent_context")


def retrieve_plain(corpus: Corpus, subs: DataFrame, mode: Mode = Mode(k=5, top=None, parents=False), n: int = 2) -> DataFrame:
    """(question_id, place, sub_no, rank, key): without a scorer, the first n of the sub-queries' results in order, each chunk once."""
    ids = subs.select("question_id", "sub_no", F.concat_ws("#", "question_id", "sub_no").alias("query_id"))
    found = search(corpus, _asked(subs), mode).join(ids, "query_id")
    first = found.groupBy("question_id", "key").agg(F.min(F.struct("sub_no", "rank")).alias("o"))
    place = F.row_number().over(W.partitionBy("question_id").orderBy("o", "key")).cast("long")
    return first.withColumn("place", place).where(F.col("place") <= n).select("question_id", "place", "o.sub_no", "o.rank", "key")


VERDICT = "struct<relevant:boolean,refined_queries:array<string>>"


def previews(contexts: DataFrame, chunks: int = 5, chars: int = 250) -> DataFrame:
    """(question_id, previews): the beginnings of a question's first chunks, a line each, for a model to judge."""
    place = F.row_number().over(W.partitionBy("question_id").orderBy("sub_no", "rank"))
    first = contexts.withColumn("n", place).where(F.col("n") <= chunks)
    line = F.concat(F.lit("[Chunk "), F.col("n").cast("string"), F.lit(": "), T.pretty_source(F.col("source_file")), F.lit("] "), F.left(F.coalesce("content", F.lit("")), F.lit(chars)))
    return first.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("previews"))


def verify(contexts: DataFrame, questions: DataFrame, judge: Callable[[Column, Column], Column], again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`contexts`, where a model refused a question's and listed better queries replaced by what `again` finds for these, once.

    judge: the model's answer to (question, previews), which holds a JSON object of VERDICT; again: makes contexts of
    (question_id, sub_no, sub_query). Without a verdict, refined queries or new results a question's context stays; one without a context isn't judged.
    """
    asked = questions.join(previews(contexts), "question_id")
    verdict = asked.select("question_id", T.json_span(judge(F.col("question"), F.col("previews")), VERDICT).alias("v"))
    refused = verdict.where(~F.coalesce("v.relevant", F.lit(True))).select("question_id", F.filter("v.refined_queries", lambda x: T.strip(x) != "").alias("q")).where(F.size("q") > 0)
    subs = refused.select("question_id", F.posexplode(F.array_distinct("q")).alias("sub_no", "sub_query")).withColumn("sub_no", F.col("sub_no").cast("long"))
    new = again(cut(subs))
    return contexts.join(new.select("question_id").distinct(), "question_id", "left_anti").unionByName(new)


def mean_score(contexts: DataFrame) -> DataFrame:
    """(question_id, mean_score): the mean of a question's search scores, missing ones 0."""
    return contexts.groupBy("question_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"))


def prompts(contexts: DataFrame, questions: DataFrame, template: str = "Context:\n{context}\n\nQuestion:\n{question}", chars: int = 8500) -> DataFrame:
    """(question_id, question, prompt_context, prompt) of all questions; those without a context have an empty one."""
    whole = S.assemble(contexts.withColumn("rank", F.struct("sub_no", "rank")), chars)
    joined = questions.join(whole, "question_id", "left").withColumn("prompt_context", F.coalesce("prompt_context", F.lit("")))
    filled = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.col("prompt_context")), F.lit("{question}"), F.coalesce("question", F.lit("")))
    return joined.select("question_id", "question", "prompt_context", filled.alias("prompt"))


def answers(prompted: DataFrame, generate: Callable[[Column], Column], audit: str | None = "Context:\n{context}\n\nDraft:\n{draft}\n\nQuestion:\n{question}") -> DataFrame:
    """(question_id, draft, answer): a model's draft, and its answer when it is asked to correct the draft by the context."""
    drafted = prompted.withColumn("draft", generate(F.col("prompt")))
    if audit is None:
        return drafted.select("question_id", "draft", F.col("draft").alias("answer"))
    again = F.lit(audit)
    for name, value in (("{context}", "prompt_context"), ("{draft}", "draft"), ("{question}", "question")):
        again = F.replace(again, F.lit(name), F.coalesce(value, F.lit("")))
    return drafted.select("question_id", "draft", generate(again).alias("answer"))


def window_sweep(contexts: DataFrame, questions: DataFrame, sizes: tuple[int, ...], measure: Callable[[Column, Column], Column]) -> DataFrame:
    """(size, question_id, chars, value): a measure of (context, question) for each budget of characters in `sizes`."""
    whole = prompts(contexts, questions, chars=max(sizes))
    each = whole.select("question_id", "question", "prompt_context", F.explode(F.array(*map(F.lit, sizes))).alias("size")).withColumn("part", F.left("prompt_context", F.col("size")))
    return each.select("size", "question_id", F.length("part").cast("long").alias("chars"), measure(F.col("part"), F.col("question")).alias("value"))

"""Measures of rankings and answers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions import text as T
from tessera.functions import tokens as K


def ranking(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision, recall, hit_rate, ndcg, mrr) at k; mrr over the whole list. relevant: (query_id, key), external labels, or (key) if they hold for all queries.

    Keys are counted once, so recall stays within 1. Queries without relevant keys score 0.
    """
    on = [c for c in ("query_id", "key") if c in relevant.columns]
    rel = relevant.select(*on).distinct()
    hit = ranked.join(rel.withColumn("hit", F.lit(1)), on, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    inside = F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)
    per = hit.groupBy("query_id").agg(F.sum(inside).alias("hits"), F.sum(inside / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    n = rel.groupBy(*on[:-1]).agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1)))
    out = (per.join(n, "query_id", "left") if len(on) == 2 else per.crossJoin(F.broadcast(n))).withColumn("n", F.coalesce("n", F.lit(0)))
    zero = lambda c, v: F.when(c, v).otherwise(F.lit(0.0))
    return out.select("query_id", (F.col("hits") / k).alias("precision"), zero(F.col("n") > 0, F.col("hits") / F.col("n")).alias("recall"), (F.col("hits") > 0).cast("double").alias("hit_rate"), zero(F.col("n") > 0, F.col("dcg") / ideal).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where `value` is made once a row however often it is used, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_f1(reference: Column, answer: Column) -> Column:
    """F1 over the sets of words."""

    def f1(both: Column) -> Column:
        a, b = both["a"], both["b"]
        return _once(F.size(F.array_intersect(a, b)), lambda n: F.when(n > 0, 2.0 * n / (F.size(a) + F.size(b))).otherwise(F.lit(0.0)))

    a, b = (F.array_distinct(T.words(F.lower(F.coalesce(c, F.lit(""))))) for c in (reference, answer))
    return _once(F.struct(a.alias("a"), b.alias("b")), f1)


def distinct_n(text: Column, n: int) -> Column:
    share = lambda grams: F.when(F.size(grams) > 0, F.size(F.array_distinct(grams)) / F.size(grams)).otherwise(F.lit(0.0))
    return _once(T.words(F.lower(F.coalesce(text, F.lit("")))), lambda w: _once(K.ngrams(w, n), share))


def _grams(w: list[str], n: int) -> Counter:
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def _stem(w: str) -> str:
    """A light suffix stripper for the overlap measures."""
    for end, put in (("sses", "ss"), ("ies", "i"), ("ing", ""), ("ed", ""), ("ly", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 3 and not (end == "s" and w.endswith("ss")):
            return w[: len(w) - len(end)] + put
    return w


def bleu(ref: list[str], hyp: list[str], most: int) -> float:
    """Up to n-grams of `most`, with brevity penalty; missing orders are smoothed by the answer's length."""
    if not hyp or not ref:
        return 0.0
    logs, fill = 0.0, 1
    for n in range(1, most + 1):
        got, have = _grams(hyp, n), _grams(ref, n)
        total, same = max(sum(got.values()), 1), sum((got & have).values())
        if n == 1 and not same:
            return 0.0
        if not same:
            fill *= 2
            same = 5 / (fill * math.log(len(hyp))) if len(hyp) > 1 else 0.0
        if not same:
            return 0.0
        logs += math.log(same / total) / most
    return min(1.0, math.exp(1 - len(ref) / len(hyp))) * math.exp(logs)


def gleu(ref: list[str], hyp: list[str]) -> float:
    """The lesser of precision and recall over n-grams of 1 to 4."""
    a, b = (sum((_grams(x, n) for n in range(1, 5)), Counter()) for x in (ref, hyp))
    return sum((a & b).values()) / max(sum(a.values()), sum(b.values()), 1)


def _lcs(a: list[str], b: list[str]) -> int:
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        u = row & places.get(x, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _f(same: float, a: int, b: int) -> float:
    return 2.0 * same / (a + b) if same else 0.0


def rouge(ref: str, hyp: str) -> tuple[float, float, float, float]:
    """F of 1-grams, 2-grams, the longest common subsequence, and that summed over lines; stemmed words."""
    split = lambda s: [_stem(w) for w in "".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split()]
    a, b = split(ref), split(hyp)
    one, two = (_f(sum((_grams(a, n) & _grams(b, n)).values()), max(len(a) - n + 1, 0), max(len(b) - n + 1, 0)) for n in (1, 2))
    lines = [split(x) for x in hyp.split("\n")]
    union = 0
    for line in (split(x) for x in ref.split("\n")):
        held: set[int] = set()
        for other in lines:
            table = [[0] * (len(other) + 1) for _ in range(len(line) + 1)]
            for i in range(len(line)):
                for j in range(len(other)):
                    table[i + 1][j + 1] = table[i][j] + 1 if line[i] == other[j] else max(table[i][j + 1], table[i + 1][j])
            i, j = len(line), len(other)
            while i and j:
                if line[i - 1] == other[j - 1]:
                    held.add(i - 1)
                    i, j = i - 1, j - 1
                elif table[i - 1][j] >= table[i][j - 1]:
                    i -= 1
                else:
                    j -= 1
        union += len(held)
    return one, two, _f(_lcs(a, b), len(a), len(b)), _f(union, len(a), len(b))


def meteor(ref: list[str], hyp: list[str]) -> float:
    """Exact and stem stages only; there is no word net offline."""
    free, pairs = dict(enumerate(ref)), []
    for same in (lambda x, y: x == y, lambda x, y: _stem(x) == _stem(y)):
        for i, w in enumerate(hyp):
            if all(i != p for p, _ in pairs) and (j := next((j for j, v in free.items() if same(w, v)), None)) is not None:
                pairs.append((i, j))
                del free[j]
    m = len(pairs)
    if not m:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b[0] != a[0] + 1 or b[1] != a[1] + 1 for a, b in zip(pairs, pairs[1:], strict=False))
    p, r = m / len(hyp), m / len(ref)
    return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / m) ** 3)


OVERLAP = ["bleu1", "bleu2", "bleu4", "gleu", "rouge1", "rouge2", "rougeL", "rougeLsum", "meteor"]


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in OVERLAP]))
def overlap(reference: pd.Series, answer: pd.Series) -> pd.DataFrame:
    """All overlap measures of a reference and an answer, as a struct."""
    rows = []
    for r, h in zip(reference.fillna(""), answer.fillna(""), strict=True):
        a, b = r.lower().split(), h.lower().split()
        rows.append((bleu(a, b, 1), bleu(a, b, 2), bleu(a, b, 4), gleu(a, b), *rouge(r, h), meteor(a, b)))
    return pd.DataFrame(rows, columns=OVERLAP)


def faithfulness(sentences: Column, similarity: Column, least: float = 0.45) -> Column:
    """The share of an answer's sentences whose similarity to the context is over `least`; both arrays of one length."""
    n = F.size(sentences)
    return F.when(n > 0, F.size(F.filter(similarity, lambda x: x > least)) / n).otherwise(F.lit(0.0))


def answer_sentences(answer: Column) -> Column:
    """Sentences of over 20 characters."""
    return F.filter(F.transform(F.split(F.replace(answer, F.lit(".\n"), F.lit(". ")), r"\. "), T.strip), lambda x: F.length(x) > 20)


def reward(similarity: Column, faithful: Column, rouge_l: Column, latency: Column, relevancy: Column) -> Column:
    return 0.35 * similarity + 0.25 * faithful + 0.20 * rouge_l + 0.10 * F.greatest(F.lit(0.0), 1 - latency / 300.0) + 0.10 * relevancy


def candidate_scores(prompt: Column, candidate: Column) -> dict[str, Column]:
    """accuracy, f1, rouge_l, distinct and total of a candidate answer over sets of words; long ones lose."""
    w = T.words(F.lower(F.coalesce(candidate, F.lit(""))))
    p, n, u = F.array_distinct(T.words(F.lower(F.coalesce(prompt, F.lit(""))))), F.size(w), F.array_distinct(w)
    same = F.size(F.array_intersect(p, u))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision, recall, distinct = safe(same, n), safe(same, F.size(p)), safe(F.size(u), n)
    f1 = safe(2 * precision * recall, precision + recall)
    penalty = F.when(n > 120, 0.3).when(n > 80, 0.6).otherwise(1.0)
    total = (f1 * 0.4 + recall * 0.85 * 0.2 + distinct * 0.1 + precision * 2.0 * 0.3) * penalty
    return {"accuracy": precision * 2.0, "f1": f1, "rouge_l": recall * 0.85, "distinct": distinct, "total": total}


def candidate_rrf(scored: DataFrame, by: str, idx: str, k: int = 60) -> DataFrame:
    """The candidate of each group with the best sum of reciprocal ranks over the five measures; ties to the first."""
    total = F.lit(0.0)
    for m in ("accuracy", "f1", "rouge_l", "distinct", "total"):
        total = total + 1.0 / (k + F.row_number().over(W.partitionBy(by).orderBy(F.round(m, 9).desc(), F.col(idx))))
    df = scored.withColumn("rrf", total)
    return df.withColumn("rn", F.row_number().over(W.partitionBy(by).orderBy(F.round("rrf", 12).desc(), F.col(idx)))).where("rn = 1").drop("rn")


def macro(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean of each measure, over all rows or by configuration."""
    return rows.groupBy(*(by or [])).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])


def reward_trend(rows: DataFrame, seq: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(first_half, second_half, change_percent): means before and after half of the rows, in order of `seq`."""
    w = W.partitionBy(*(by or []))
    half = rows.withColumn("_rn", F.row_number().over(w.orderBy(seq))).withColumn("_h", F.floor(F.count("*").over(w) / 2))
    out = half.groupBy(*(by or [])).agg(F.avg(F.when(F.col("_rn") <= F.col("_h"), F.col(value))).alias("first_half"), F.avg(F.when(F.col("_rn") > F.col("_h"), F.col(value))).alias("second_half"))
    return out.withColumn("change_percent", F.when(F.col("first_half") != 0, (F.col("second_half") - F.col("first_half")) / F.col("first_half") * 100))

"""Queries of ranking and answer measures and of parameter learning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import metrics, search, tuning
from tessera.plans.common import PLAIN, table
from tessera.plans.retrieval import _bm25

R6 = lambda c: F.round(c, 6).alias(c)


def ranking_metrics(spark, sf_dir):
    """Documents of good quality by the labels table count as relevant, for every question alike."""
    got = search.search_sparse(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("key"))
    return metrics.ranking(got, good).select("query_id", *map(R6, ("precision", "recall", "hit_rate", "ndcg", "mrr")))


def _pairs(spark, sf_dir):
    """Assistant turns with the text of the turn before."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("prompt", F.lag("text").over(w))
    return c.where("role = 'assistant' and prompt is not null").select("conv_id", "turn", "prompt", "text")


def answer_f1_distinct(spark, sf_dir):
    p, t = F.col("prompt"), F.col("text")
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.token_f1(p, t), 6).alias("f1"), F.round(metrics.distinct_n(t, 1), 6).alias("distinct1"), F.round(metrics.distinct_n(t, 2), 6).alias("distinct2"))


def candidate_rrf(spark, sf_dir):
    c = _pairs(spark, sf_dir).withColumns(metrics.candidate_scores(F.col("prompt"), F.col("text")))
    return metrics.candidate_rrf(c, "conv_id", "turn").select("conv_id", "turn", F.round("rrf", 9).alias("rrf"))


def overlap_metrics(spark, sf_dir):
    c = _pairs(spark, sf_dir).select("conv_id", "turn", metrics.overlap(F.col("prompt"), F.col("text")).alias("m"))
    return c.select("conv_id", "turn", *[F.round(f"m.{x}", 6).alias(x) for x in metrics.OVERLAP])


def rewards(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100))
    return e.select("event_type", F.round(metrics.reward(v, v, 1 - v, F.col("value"), v), 6).alias("reward")).groupBy("event_type").agg(F.round(F.avg("reward"), 6).alias("mean_reward"), F.count("*").alias("n"))


def ablation_means(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("config"), "value", F.length("props").cast("double").alias("size"))
    return metrics.macro(e, ["value", "size"], ["config"]).select("config", R6("value"), R6("size"))


def reward_trend(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return metrics.reward_trend(e, "event_id", "value", ["event_type"]).select("event_type", R6("first_half"), R6("second_half"), R6("change_percent"))


def best_so_far(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return tuning.best_so_far(e, "event_id", "value", ["event_type"]).select("event_type", "event_id", "best", "is_best")


def _posterior(spark, sf_dir):
    return tuning.beta_posterior(table(spark, sf_dir, "events").withColumn("r", F.col("value") / 100), "event_type", "r")


def beta_posterior(spark, sf_dir):
    return _posterior(spark, sf_dir).select("arm", R6("alpha"), R6("beta"), "pulls", R6("total_reward"), R6("mean"))


def best_arm(spark, sf_dir):
    return tuning.best_arm(_posterior(spark, sf_dir)).select("arm", R6("mean"))


def recent_rewards(spark, sf_dir):
    return tuning.recent(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_id", 10, ["event_type"])


def gaussian_posterior(spark, sf_dir):
    """Mean and deviation of the search over a grid of one parameter, after six trials."""
    import numpy as np

    s = tuning.GaussianSearch(space=(tuning.Parameter("alpha", 0.0, 1.0),))
    x = np.linspace(0, 1, 6)[:, None]
    mean, spread = s.posterior(x, 1 - (x[:, 0] - 0.4) ** 2, np.linspace(0, 1, 21)[:, None])
    return spark.createDataFrame([(round(i / 20, 2), float(m), float(d)) for i, (m, d) in enumerate(zip(mean, spread, strict=True))], "alpha double, mean double, spread double").select("alpha", R6("mean"), R6("spread"))


_PAIRS = "(SELECT * FROM (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations) WHERE role = 'assistant' AND prompt IS NOT NULL)"
_SET = lambda c: f"list_filter(string_split(regexp_replace(lower({c}), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')"
_BI = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
_SCORES = f"(SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, 2 * p AS accuracy, r * 0.85 AS rouge_l, CASE WHEN n > 120 THEN 0.3 WHEN n > 80 THEN 0.6 ELSE 1 END AS penalty FROM (SELECT conv_id, turn, n, CASE WHEN n > 0 THEN u / n ELSE 0 END AS \"distinct\", CASE WHEN n > 0 THEN same / n ELSE 0 END AS p, CASE WHEN m > 0 THEN same / m ELSE 0 END AS r FROM (SELECT conv_id, turn, len({_SET('text')}) AS n, len(list_distinct({_SET('text')})) AS u, len(list_distinct({_SET('prompt')})) AS m, len(list_intersect(list_distinct({_SET('prompt')}), list_distinct({_SET('text')}))) AS same FROM {_PAIRS})))"

SQL = {
    "ranking_metrics": f"WITH {_bm25(PLAIN)}, g AS (SELECT doc_id FROM labels WHERE quality = 1), h AS (SELECT query_id, rank, (doc_id IN (FROM g))::INT AS hit FROM s WHERE rank <= 20), gn AS (SELECT count(DISTINCT doc_id) AS n FROM g) SELECT query_id, round(sum(hit) FILTER (WHERE rank <= 5) / 5, 6)::DOUBLE AS precision, round(coalesce(sum(hit) FILTER (WHERE rank <= 5) / any_value(gn.n), 0), 6)::DOUBLE AS recall, (coalesce(sum(hit) FILTER (WHERE rank <= 5), 0) > 0)::INT::DOUBLE AS hit_rate, round(sum(hit / log2(rank + 1)) FILTER (WHERE rank <= 5) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) r(i)), 6)::DOUBLE AS ndcg, round(coalesce(1 / min(rank) FILTER (WHERE hit = 1), 0), 6)::DOUBLE AS mrr FROM h, gn GROUP BY query_id",
    "answer_f1_distinct": f"SELECT conv_id, turn, round(CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6)::DOUBLE AS f1, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END, 6)::DOUBLE AS distinct1, round(CASE WHEN len(w) > 1 THEN len(list_distinct({_BI})) / (len(w) - 1) ELSE 0 END, 6)::DOUBLE AS distinct2 FROM (SELECT conv_id, turn, list_distinct({_SET('prompt')}) AS a, list_distinct({_SET('text')}) AS b, {_SET('text')} AS w FROM {_PAIRS})",
    "candidate_rrf": f"WITH x AS (SELECT *, (f1 * 0.4 + rouge_l * 0.2 + \"distinct\" * 0.1 + accuracy * 0.3) * penalty AS total FROM {_SCORES}), y AS (SELECT conv_id, turn, " + " + ".join(f"1 / (60 + row_number() OVER (PARTITION BY conv_id ORDER BY round(\"{m}\", 9) DESC, turn))" for m in ("accuracy", "f1", "rouge_l", "distinct", "total")) + " AS rrf FROM x) SELECT conv_id, turn, round(rrf, 9)::DOUBLE AS rrf FROM y QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY round(rrf, 12) DESC, turn) = 1",
    "rewards": "SELECT event_type, round(avg(reward), 6)::DOUBLE AS mean_reward, count(*) AS n FROM (SELECT event_type, round(0.35 * v + 0.25 * v + 0.20 * (1 - v) + 0.10 * greatest(0, 1 - value / 300) + 0.10 * v, 6) AS reward FROM (SELECT *, greatest(0, least(1, value / 100)) AS v FROM events)) GROUP BY 1",
    "ablation_means": "SELECT event_type AS config, round(avg(value), 6)::DOUBLE AS value, round(avg(len(props)), 6)::DOUBLE AS size FROM events GROUP BY 1",
    "reward_trend": "WITH h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) // 2 AS half FROM events), a AS (SELECT event_type, avg(value) FILTER (WHERE rn <= half) AS x, avg(value) FILTER (WHERE rn > half) AS y FROM h GROUP BY 1) SELECT event_type, round(x, 6) AS first_half, round(y, 6) AS second_half, round((y - x) / x * 100, 6) AS change_percent FROM a",
    "best_so_far": "SELECT event_type, event_id, max(value) OVER w AS best, value >= max(value) OVER w AS is_best FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)",
    "beta_posterior": "SELECT event_type AS arm, round(1 + sum(r), 6) AS alpha, round(1 + sum(1 - r), 6) AS beta, count(r) AS pulls, round(sum(r), 6) AS total_reward, round((1 + sum(r)) / (2 + count(r)), 6) AS mean FROM (SELECT event_type, greatest(0, least(1, value / 100)) AS r FROM events) GROUP BY 1",
    "best_arm": "SELECT event_type AS arm, round((1 + sum(r)) / (2 + count(r)), 6) AS mean FROM (SELECT event_type, greatest(0, least(1, value / 100)) AS r FROM events) GROUP BY 1 ORDER BY round(mean, 12) DESC, arm LIMIT 1",
    "recent_rewards": "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 10",
}

QUERIES = {f.__name__: f for f in (ranking_metrics, answer_f1_distinct, candidate_rrf, overlap_metrics, rewards, ablation_means, reward_trend, best_so_far, beta_posterior, best_arm, recent_rewards, gaussian_posterior)}

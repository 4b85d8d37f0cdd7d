"""Parameter learning: Beta bandit and a Gaussian-process search. State is small by nature (arms, under 100 trials)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def beta_posterior(rewards: DataFrame, arm: str = "arm", reward: str = "reward") -> DataFrame:
    """(arm, alpha, beta, pulls, total_reward, mean) from a Beta(1, 1) prior; rewards are held to 0..1."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(reward)))
    out = rewards.groupBy(F.col(arm).alias("arm")).agg((1 + F.sum(r)).alias("alpha"), (1 + F.sum(1 - r)).alias("beta"), F.count(F.col(reward)).alias("pulls"), F.sum(r).alias("total_reward"))
    return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def with_new_arms(arms: DataFrame, posterior: DataFrame) -> DataFrame:
    """Every arm of `arms` (arm), the prior where it has no history."""
    out = arms.join(posterior, "arm", "left")
    fill = {"alpha": 1.0, "beta": 1.0, "pulls": 0, "total_reward": 0.0, "mean": 0.5}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def best_arm(posterior: DataFrame) -> DataFrame:
    """The arm with the best mean, the first by name on a tie."""
    return posterior.orderBy(F.round("mean", 12).desc(), "arm").limit(1)


def thompson(posterior: DataFrame, seed: int = 0) -> str:
    """The arm whose draw from its posterior is largest; a row an arm comes to the driver."""
    rng = np.random.default_rng(seed)
    rows = posterior.orderBy("arm").select("arm", "alpha", "beta").collect()
    return max(rows, key=lambda r: rng.beta(r["alpha"], r["beta"]))["arm"]


def recent(history: DataFrame, seq: str, n: int, by: list[str] | None = None) -> DataFrame:
    """The last n rows, of each group if any."""
    return history.withColumn("_rn", F.row_number().over(W.partitionBy(*(by or [])).orderBy(F.col(seq).desc()))).where(F.col("_rn") <= n).drop("_rn")


def best_so_far(trials: DataFrame, seq: str, reward: str, by: list[str]) -> DataFrame:
    """Adds best, the running maximum, and is_best, whether the row reaches it."""
    w = W.partitionBy(*by).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    return trials.withColumn("best", F.max(reward).over(w)).withColumn("is_best", F.col(reward) >= F.col("best"))


@dataclass(frozen=True)
class Parameter:
    name: str
    low: float
    high: float
    whole: bool = False


SPACE = (Parameter("alpha", 0.0, 1.0), Parameter("top_k", 3, 15, True), Parameter("rrf_k", 20, 100, True), Parameter("reranker_top_n", 2, 5, True))


@dataclass
class GaussianSearch:
    """Upper-confidence search over `space`; random until `warm` trials are known."""

    space: tuple[Parameter, ...] = SPACE
    kappa: float = 2.0
    scale: float = 0.3
    noise: float = 1e-4
    warm: int = 5
    candidates: int = 200

    def normalize(self, params: dict) -> np.ndarray:
        return np.array([(params[p.name] - p.low) / (p.high - p.low) for p in self.space])

    def denormalize(self, x: np.ndarray) -> dict:
        raw = {p.name: p.low + v * (p.high - p.low) for p, v in zip(self.space, x, strict=True)}
        return {p.name: int(round(raw[p.name])) if p.whole else round(float(raw[p.name]), 3) for p in self.space}

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(2) / self.scale**2)

    def posterior(self, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation at each row of `at`, for a prior of mean 0 and variance 1."""
        cross = self.kernel(at, x)
        solved = np.linalg.solve(self.kernel(x, x) + self.noise * np.eye(len(x)), np.column_stack([y, cross.T]))
        return cross @ solved[:, 0], np.sqrt(np.maximum(0, 1 - np.einsum("ij,ji->i", cross, solved[:, 1:])))

    def suggest(self, trials: list[tuple[dict, float]], seed: int = 0) -> dict:
        rng = np.random.default_rng(seed)
        if len(trials) < self.warm:
            return self.denormalize(rng.random(len(self.space)))
        at = rng.random((self.candidates, len(self.space)))
        mean, spread = self.posterior(np.stack([self.normalize(p) for p, _ in trials]), np.array([r for _, r in trials]), at)
        return self.denormalize(at[int(np.argmax(mean + self.kappa * spread))])


def episodes(run, questions: list, search: GaussianSearch, n: int, seed: int = 0) -> list[dict]:
    """n trials in turn over cycling questions: each depends on those before. run(question, params) gives a reward."""
    done: list[tuple[dict, float]] = []
    out = []
    for i in range(n):
        params = search.suggest(done, seed + i)
        reward = float(run(questions[i % len(questions)], params))
        done.append((params, reward))
        out.append({"trial_no": i + 1, "params": params, "reward": reward, "best": max(r for _, r in done)})
    return out

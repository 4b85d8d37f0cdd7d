import math
from collections import Counter, defaultdict

import pytest

from tessera.llm import kneser_ney as kn


def toks(t):
    return [*(t or "").encode().lower().split(), "END"]


def brute(train):
    pairs, uni = Counter(), Counter()
    for t in map(toks, train):
        uni.update(t)
        pairs.update(zip(["START", *t[:-1]], t, strict=True))
    follows, begins, n = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (v, _), c in pairs.items():
        begins[v] += c
        n[v][min(c, 3) - 1] += 1
    d2, d1 = (kn.discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (pairs, follows))
    d2, d1 = (0, *d2), (0, *d1)
    left = sum(d1[min(c, 3)] for c in follows.values()) / max(len(pairs), 1) if pairs else 1.0

    def p(v, w):
        low = max(follows[w] - d1[min(follows[w], 3)], 0) / max(len(pairs), 1) + left / (len(uni) + 1)
        if not begins[v]:
            return low
        c = pairs[v, w]
        return max(c - d2[min(c, 3)], 0) / begins[v] + sum(d2[k + 1] * n[v][k] for k in range(3)) / begins[v] * low

    return p, uni, n, begins


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_equals_brute_force(spark, docs, parts):
    train = docs.where("doc_id % 3 <> 0")
    model = kn.train(train, parts=parts, flush=3000)
    p, uni, _, _ = brute([r["text"] for r in train.collect()])
    total = sum(uni.values())
    assert (model.tokens, model.types) == (total, len(uni))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in kn.score(docs, model).collect():
        t = toks(text[r["doc_id"]])
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(uni[w] > 0 for w in t)
        assert r["score"] == pytest.approx(sum(math.log10(p(v, w)) for v, w in zip(["START", *t[:-1]], t, strict=True)), rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t), rel=1e-9)


def test_probabilities_sum_to_one():
    p, uni, _, _ = brute(["a b c a b d", "a c b", "d d a b"] * 3 + ["x y z"])
    for v in ("START", b"a", b"d", b"never"):
        assert sum(p(v, w) for w in uni) + p(v, "unseen") == pytest.approx(1.0)


def test_held_out_texts_are_better_modelled(spark, docs):
    got = kn.score(docs.where("doc_id % 3 = 0"), kn.train(docs.where("doc_id % 3 <> 0"))).collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_odd_rows_and_empty(spark, odd, empty):
    got = kn.score(odd, kn.train(odd)).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    none = kn.score(odd, kn.train(empty)).collect()
    assert {(r["n_known"], r["score"], r["base_score"]) for r in none} == {(0, 0.0, 0.0)}
    assert kn.score(empty, kn.train(odd)).count() == 0

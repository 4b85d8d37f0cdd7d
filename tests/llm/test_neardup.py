import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tessera.llm import neardup


def brute(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        h = [xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        out.append(sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)))
    return out


def closure(fps, keys):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(fps))]


def test_triples_cover_every_four_positions():
    from itertools import combinations

    assert all(any(set(t) <= set(q) for t in neardup.TRIPLES) for q in combinations(range(8), 4))


def test_equals_brute_force(docs):
    rows = docs.orderBy("doc_id").collect()
    want = brute([r["text"] for r in rows])
    got = {r["key"]: (r["fp"], r["component"]) for r in neardup.near_duplicates(docs).collect()}
    assert [got[r["doc_id"]][0] & (1 << 64) - 1 for r in rows] == want
    assert [got[r["doc_id"]][1] for r in rows] == closure(want, [r["doc_id"] for r in rows])


@pytest.mark.parametrize("split", [50_000, 7])
def test_links_of_clusters_and_chains(spark, split):
    rng = np.random.default_rng(5)
    fps = {0}
    for _ in range(6):
        x = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(50):  # a chain of small steps, and bits around it
            fps.add(x)
            x ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False))
    fps |= {int(rng.integers(0, 2**63)) for _ in range(200)} | {1, 3, 2**63}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, id long")
    roots = {r["id"]: r["root"] for r in neardup.components(neardup.links(df, split)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == closure(fps, list(range(len(fps))))


def test_walk_returns_a_forest():
    x = np.array([1, 3, 7, 1 << 40, 1 << 40 | 1, 0xFFFFFFFFFFFFFFFF], np.uint64)
    a, b = neardup.walk(x, np.arange(6))
    assert sorted(zip(a, b, strict=True)) and len(a) == 4


def test_odd_rows_and_deduplication(odd):
    rows = odd.collect()
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    zero = {r["key"]: r["component"] for r in got if r["fp"] == 0}
    assert zero == {1: 1, 2: 1, 3: 1}
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7]


def test_long_chain_of_components(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r["id"]: r["root"] for r in neardup.components(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000} or got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}


def jaccard_closure(texts, keys):
    """Components of every pair that shares 0.8 of its five-word shingles or is within 4 bits, by brute force over the words themselves."""
    narrow, sets = brute(texts), []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            near = shared and 10 * shared >= 8 * (len(sets[i]) + len(sets[j]) - shared)
            if near:
                pairs.add((keys[j], keys[i]))
            if near or (narrow[i] ^ narrow[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [keys[find(i)] for i in range(len(texts))], pairs


def edited(rng):
    """Texts of 40 to 400 words, each with copies of which one word in 10 to 60 is changed: similarities on both sides of 0.8."""
    out = []
    for n in (40, 90, 150, 250, 400):
        for _ in range(8):
            w = [f"w{x}" for x in rng.integers(0, 5000, n)]
            out.append(w)
            for gap in (10, 20, 30, 38, 42, 46, 50, 60):
                out.append([f"e{rng.integers(0, 10**9)}" if j % gap == 5 else x for j, x in enumerate(w)])
    return [" ".join(w) for w in out]


def test_overlap_links_equal_brute_force(spark):
    texts = edited(np.random.default_rng(3))
    keys = list(range(len(texts)))
    want, pairs = jaccard_closure(texts, keys)
    df = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")
    assert {r["key"]: r["component"] for r in neardup.near_copies(df).collect()} == dict(zip(keys, want, strict=True))
    got = {(min(r), max(r)) for r in neardup.overlap_links(df.withColumnRenamed("doc_id", "key")).collect()}
    assert pairs and got <= pairs
    dealt = neardup.components(neardup.overlap_links(df.withColumnRenamed("doc_id", "key"), 3)).collect()
    assert dealt and {r["id"]: r["root"] for r in dealt} == {r["id"]: r["root"] for r in neardup.components(neardup.overlap_links(df.withColumnRenamed("doc_id", "key"))).collect()}


def test_overlap_links_with_frequent_shingles(spark, monkeypatch):
    line = " ".join(f"common{i}" for i in range(12))
    texts = [line + " " + t for t in edited(np.random.default_rng(4))[:180]]
    keys = list(range(len(texts)))
    late = np.sort(neardup.shingles(line))
    monkeypatch.setattr(neardup, "_late", lambda rows: late)
    df = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")
    assert {r["key"]: r["component"] for r in neardup.near_copies(df).collect()} == dict(zip(keys, jaccard_closure(texts, keys)[0], strict=True))


def test_deduplication_keeps_one_of_each_true_near_copy(docs):
    rows = docs.orderBy("doc_id").collect()
    roots, _ = jaccard_closure([r["text"] for r in rows], [r["doc_id"] for r in rows])
    assert sorted(r["doc_id"] for r in neardup.deduplicated(docs).collect()) == sorted(set(roots))


def test_a_pair_that_meets_often_is_a_candidate_once():
    import pyarrow as pa

    texts = [" ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(3, 200))]
    held = [(k, len(neardup.shingles(t)), k, neardup._cells(neardup.shingles(t), neardup.CELLS)) for k, t in enumerate(texts)]
    rows = [(post, 0, *x) for post in range(50) for x in held]
    batch = pa.RecordBatch.from_pylist([dict(zip(("post", "pair", "id", "size", "root", "cells"), r, strict=True)) for r in rows])
    got = [tuple(r.values()) for b in neardup._candidates(iter([batch])) for r in b.to_pylist()]
    assert got == [(0, 1)]
    # forgotten pairs come again, none is lost
    assert {tuple(r.values()) for b in neardup._candidates(iter([batch]), 0) for r in b.to_pylist()} == {(0, 1)}


def test_of_postings_with_the_same_rows_one_stays(spark):
    sets = [[1, 2], [1, 2], [1, 2, 3], [2, 3], [1, 2, 3], [1, 3, 3, 4], [1, 2, 2, 4], [1, 4], [5], [6, 6]]
    df = spark.createDataFrame([(p, i, 10 * i) for p, ids in enumerate(sets) for i in ids], "post long, id long, size int")
    got = sorted(tuple(r) for r in neardup._sums(df).collect())
    assert got == [(0, 1, 10, 2), (2, 1, 10, 3), (3, 2, 20, 2), (5, 1, 10, 4), (6, 1, 10, 4), (7, 1, 10, 2)]


def test_all_shingles_of_a_common_passage_come_last_rarest_first(spark):
    rng = np.random.default_rng(6)
    often, seldom = (" ".join(f"{name}{i}" for i in range(30)) for name in ("often", "seldom"))
    texts = [" ".join([often, f"between{k}", seldom if k < 10 else "", *(f"w{x}" for x in rng.integers(0, 10**6, 60))]) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = neardup._late(df, one_in=1)
    assert len(got) == 52 and set(got[-26:].tolist()) == set(neardup.shingles(often).tolist())
    assert set(got[:26].tolist()) == set(neardup.shingles(seldom).tolist())

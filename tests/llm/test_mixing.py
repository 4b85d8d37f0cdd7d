import re

import pytest

from tessera.llm import mixing


def targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, open_ = budget * sum(sizes.values()), {}, set(order)
    while open_:
        share = {s: total * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            total -= out[s]
        open_ -= over
    return out


def check(df, mix=mixing.Mix()):
    rows = df.collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    per = {}
    for r, n in zip(rows, size, strict=True):
        per[r["source"]] = per.get(r["source"], 0) + n
    want = targets(per)
    got = mixing.taken(df, mix).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(size)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(want[r["src"]]) and r["source_size"] == per[r["src"]]
        taken[r["src"]] = taken.get(r["src"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    return got


@pytest.mark.parametrize("block", [7, 64, 512])
def test_targets_are_met(docs, block):
    check(docs, mixing.Mix(block=block, slot_bucket=50))


def test_uneven_sources(spark):
    rows = [(i, "w " * (i % 9), "big") for i in range(400)] + [(1000, "a b c", "tiny"), (1001, "x", None), (1002, "", "none"), (1003, "é f " * 50, "Z")]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_reruns_agree(docs):
    a, b = (sorted(map(tuple, mixing.taken(docs).collect())) for _ in range(2))
    assert a == b


def test_slots_are_spread(spark, docs):
    """Each source's share of any run of slots is near its share of the whole."""
    mix = mixing.Mix(block=16)
    slots = mixing.schedule(mixing.targets(mixing.sized(docs), mix), mix).orderBy("slot").collect()
    n = len(slots)
    share = {}
    for r in slots:
        share[r["s"]] = share.get(r["s"], 0) + 1
    for a in range(0, n - 500, 500):
        part = [r["s"] for r in slots[a : a + 500]]
        for s, k in share.items():
            assert abs(part.count(s) - 500 * k / n) < 8


def test_mixed_rows(docs):
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    words = lambda t: len(t.split())
    total = sum(words(r["text"]) for r in docs.collect())
    assert sum(words(r["text"]) for r in got.collect()) == pytest.approx(1.5 * total, rel=0.1)


def test_odd_rows(odd):
    check(odd)

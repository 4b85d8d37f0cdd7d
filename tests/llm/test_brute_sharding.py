"""Label propagation in plain Python, to compare with."""

import random
from collections import Counter

import pytest
from xxhash import xxh64_intdigest

from tessera.llm import sharding


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*values, seed=42):
    """Spark's xxhash64 of texts and 32-bit integers."""
    for v in values:
        seed = xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(4, "little"), seed)
    return signed(seed)


def plain(nodes, shards, rounds):
    """{(h, grp): (shard, slot)} of rows (h, grp), for groups that fit a shard's quota."""
    total = len(nodes)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    members = Counter(g for _, g in nodes if g is not None)
    linked = [[h, g, h % shards] for h, g in nodes if members[g] > 1 and g is not None]
    near = lambda h, g: (hashed(g) >> 56) * 256 + (h >> 8) % 256
    for _ in range(rounds):
        room = [q - n for q, n in zip(quota, (sum(x[2] == s for x in linked) for s in range(shards)), strict=True)]
        counts, best = Counter((g, s) for _, g, s in linked), {}
        for (g, s), n in counts.items():
            if room[s] > 0:
                best[g] = max(best.get(g, (-1,)), (n, -(hashed(g, s) % (1 << 30)), s))
        asks = {}
        for x in linked:
            if x[1] in best and best[x[1]][2] != x[2] and room[x[2]] > 0:
                asks.setdefault(best[x[1]][2], []).append(x)
        moved = False
        for to, rows in asks.items():
            for x in sorted(rows, key=lambda x: (near(x[0], x[1]), x[0]))[: room[to]]:
                x[2], moved = to, True
        if not moved:
            break
    out, pool = {}, [(h, g) for h, g in nodes if g is None or members[g] == 1]
    for s in range(shards):
        rows = sorted((x for x in linked if x[2] == s), key=lambda x: (near(x[0], x[1]), x[0]))
        out |= {(h, g): s for h, g, _ in rows[: quota[s]]}
        pool += [(h, g) for h, g, _ in rows[quota[s] :]]
    order = lambda r: ((hashed(r[1]) >> 58) * 64 + r[0] % 64 if r[1] is not None and members[r[1]] > 1 else 4096 + (r[0] >> 52), r[0])
    pool = iter(sorted(pool, key=order))
    for s in range(shards):
        for _ in range(quota[s] - sum(v == s for v in out.values())):
            out[next(pool)] = s
    slots = {}
    for s in range(shards):
        slots |= {r: (s, i) for i, r in enumerate(sorted((r for r, v in out.items() if v == s), key=lambda r: (r[0] >> 52, r[0])))}
    return slots


@pytest.mark.parametrize(("seed", "shards", "rounds"), [(1, 4, 12), (2, 7, 12), (3, 3, 1)])
def test_equals_a_plain_version(spark, seed, shards, rounds):
    rng = random.Random(seed)
    groups = [None] * 20 + [f"g{i}" for i in range(25)] * 4 + [f"one {i}" for i in range(30)] + ["large"] * 14
    nodes = [(rng.getrandbits(63) * rng.choice((1, -1)), g) for g in groups]
    got = sharding.propagate(spark.createDataFrame(nodes, "h long, grp string").repartition(3), shards, rounds).collect()
    assert {(r["h"], r["grp"]): (r["shard"], r["slot"]) for r in got} == plain(nodes, shards, rounds)

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import oracle, queries, topk


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 300)), int(rng.integers(1, 30))
    x = (rng.integers(-50, 50, (n, d)) * (rng.random((n, d)) < rng.choice([0.05, 0.3, 1.0]))).astype(np.int64)
    x = np.abs(x) if seed % 4 == 0 else x
    if seed % 5 == 0:
        x[: n // 2] = x[0]
    ids = rng.permutation(n * 3)[:n]
    index = topk.postings(ids, np.full(n, d), x.ravel())
    for q in range(min(n, 8)):
        got, score = topk.search(index, int(ids[q]), x[q], 5)
        want = sorted((-int(s), int(i)) for s, i in zip(x @ x[q], ids, strict=True) if i != ids[q])[:5]
        assert [(-s, i) for s, i in want] == list(zip(score.tolist(), got.tolist(), strict=True))


def brute(rows, k=5):
    """(query_id, rank, id, score) over the rows (id, vector) as they are: every row but the query's own."""
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, w) in enumerate(fine):
        if q % 50 == 0:
            clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
            best = sorted((-clip(sum(x * y for x, y in zip(w, v, strict=False))), i) for b, (i, v) in enumerate(fine) if b != a)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


ODD = [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (None, [1.0]), (250, []), (0, [0.5, 0.5]), (7, [1.0] * 8), (7, [1.0] * 8), (50, [2.0, -1.0]), (50, [2.0, -1.0]), (100, [])]
WIDE = [(300, [200000.0, 1.0]), (301, [-3e9, 5.5]), (350, [1e17, -1.0]), (350, [3e38] * 3), (302, [1.0] * 4000)]


@pytest.mark.parametrize("more", [[], WIDE])
def test_shards_blocks_and_odd_rows(spark, more):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(150)] + ODD + more
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, id string, row int").repartition(3)
    v = topk.integers(df)
    for sizes in ((4096, 1024, 64), (16, 2, 64), (16, 2, 3)):
        got = topk.top_k(v, v.where("id % 50 = 0"), 5, *sizes)
        assert sorted(map(tuple, got.select("query_id", "rank", "id", "score").collect())) == brute(rows)


def test_query_equals_brute_force_and_sql_over_repeats(spark, tmp_path):
    rows = [(i % 120, [float((i * 7 + j * 3) % 11 - 5) / 4 for j in range(6)]) for i in range(300)] + ODD
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(path)
    got = sorted(map(tuple, queries.op1_maxscore_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert sorted(con.sql(oracle.SQL["op1_maxscore_topk"]).fetchall()) == got


@pytest.mark.parametrize("bar", [-500, 0, 300, 2000])
def test_a_bar_leaves_out_only_what_is_below(bar):
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (200, 12)).astype(np.int64)
    index = topk.postings(np.arange(200), np.full(200, 12), x.ravel())
    for q in range(20):
        got, score = topk.search(index, q, x[q], 5, bar)
        want = sorted((-int(s), int(i)) for i, s in enumerate(x @ x[q]) if i != q)[:5]
        assert {(s, i) for s, i in want if -s >= bar} <= {(-int(s), int(i)) for s, i in zip(score, got, strict=True)}


def test_empty(spark):
    v = topk.integers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).count() == 0


def test_fewer_rows_than_k(spark):
    v = topk.integers(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r)[1:] for r in topk.top_k(v, v.where(F.col("id") == 0)).collect()] == [(0, 1, 1, 131072)]

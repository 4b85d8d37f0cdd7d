"""Exact top-k inner-product search over sharded postings by MaxScore.

Vectors are sparse: terms with integer weights of either sign. Rows are dealt to shards of about `shard` rows by a
hash of their number; a shard's postings (rows and weights by term, with each term's bounds) are a file in the shared
folder, written once. A task has a block of queries and a span of shards: it reads one shard after the other, and
the k-th best score so far is the bar that rows of the next ones have to reach. The spans' best are merged.

In a shard a query's terms are taken by falling width of their contributions. Those up to the point where a
row met by none of them can't reach the k-th best lower bound any more are essential: their postings are
added up. The others are only probed for the rows that are still competitive, and these get fewer with each.
Bounds are exact integers, ties included, so no result is lost. Where products may pass 64 bits all terms are
essential and added as whole numbers of any length.

Rows of a null id, and null or non-finite components (also after scaling), take no part. Every other row is a candidate
and may ask, repeated ones too; only a query's own row isn't its candidate, so other rows of its id are. Vectors may
be of any length, an empty one scores 0 with everything. Scores beyond 64 bits count as the nearest 64-bit number.
Empty tables give no rows; columns other than the vector and the id are left behind, whatever their names.
"""

from __future__ import annotations

import pickle
import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh_dir

#: Weights from here on are kept as Python's integers.
WIDE = 1 << 31
FAR = -(1 << 62)


def whole(x: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers where all are below WIDE, else as Python's."""
    return x.astype(np.int64) if not len(x) or np.abs(x).max() < WIDE else np.array([int(v) for v in x.tolist()], object)


def postings(ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray, rows: np.ndarray | None = None) -> dict:
    """The index of one shard: ids in order, with their rows' numbers (by default the ids); per term the rows' places and weights, and the term's bounds."""
    by = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by] = np.arange(len(ids))
    row = np.repeat(place, sizes)
    term = np.arange(len(weights)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(sizes) else np.zeros(0, np.int64)
    there = weights != 0
    row, term, weight = row[there], term[there], weights[there]
    order = np.lexsort((row, term))
    row, term, weight = row[order].astype(np.int32), term[order], weight[order]
    weight = weight.astype(np.int32) if weight.dtype != object else weight
    terms, start = np.unique(term, return_index=True)
    return {"ids": ids[by], "rows": (ids if rows is None else rows)[by], "terms": terms, "start": np.r_[start, len(term)].astype(np.int64), "row": row, "weight": weight, "high": np.maximum.reduceat(weight, start) if len(term) else weight, "low": np.minimum.reduceat(weight, start) if len(term) else weight}


def wide_search(index: dict, mine: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """`search` with integers of any length."""
    score = [0] * len(index["ids"])
    for i, t in enumerate(index["terms"].tolist()):
        if t < len(query) and (q := int(query[t])):
            a, b = index["start"][i], index["start"][i + 1]
            for r, w in zip(index["row"][a:b].tolist(), index["weight"][a:b].tolist(), strict=True):
                score[r] += q * w
    held = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in score]
    best = sorted(set(range(len(held))) - set(mine.tolist()), key=lambda r: (-held[r], r))[:k]
    return index["ids"][best], np.array([held[r] for r in best], np.int64)


def search(index: dict, own: int, query: np.ndarray, k: int, bar: int = FAR) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the shard's k best rows for one query, best first, ties to the smaller id; those below `bar` may be left out.

    own: the number of the row that asks, which is no candidate.
    """
    ids, n = index["ids"], len(index["ids"])
    mine = np.flatnonzero(index["rows"] == own)
    terms, start, row, weight = index["terms"], index["start"], index["row"], index["weight"]
    at = np.flatnonzero((terms < len(query)))
    q = query[terms[at]]
    at, q = at[q != 0], q[q != 0]
    tops = [np.abs(index[x][at].astype(float)) for x in ("high", "low")]
    if weight.dtype == object or q.dtype == object or (np.abs(q.astype(float)) * np.maximum(*tops)).sum() >= 1 << 61:
        return wide_search(index, mine, query, k)
    ends = np.stack([q * index["high"][at].astype(np.int64), q * index["low"][at].astype(np.int64)])
    high, low = ends.max(0), ends.min(0)
    sparse = start[at + 1] - start[at] < n  # rows without the term get nothing of it
    high, low = np.where(sparse, np.maximum(high, 0), high), np.where(sparse, np.minimum(low, 0), low)
    by = np.argsort(low - high, kind="stable")
    at, q, high, low = at[by], q[by], high[by], low[by]
    more = np.r_[np.cumsum(high[::-1])[::-1], 0]  # the most that terms from here on can add
    less = np.r_[np.cumsum(low[::-1])[::-1], 0]
    if more[0] < bar:
        return ids[:0], np.zeros(0, np.int64)
    score = np.zeros(n, np.int64)
    score[mine] = FAR
    m, alive = len(at), None
    least_of = lambda x: np.delete(x, mine).min(initial=0) if len(mine) else x.min(initial=0)
    for j in range(m):
        a, b = start[at[j]], start[at[j] + 1]
        if alive is None:  # essential: traverse
            if b - a == n:
                score += q[j] * weight[a:b]
            else:
                score[row[a:b]] += q[j] * weight[a:b]
            # nothing can fall off while the terms to come can add more than the scores are apart
            if n > 4 * k and j % 2 and max(score.max() + less[j + 1], bar) > least_of(score) + more[j + 1]:
                bound = max(np.partition(score, n - k)[n - k] + less[j + 1], bar)
                near = score + more[j + 1] >= bound
                # the rest is non-essential once what it can add leaves few rows competitive
                if more[j + 1] < bound or near.sum() * 8 < n:
                    alive = np.flatnonzero(near)
                    part = score[alive]
        else:  # probe
            if b - a == n:
                part = part + q[j] * weight[a:b][alive]
            else:
                spot = np.searchsorted(row[a:b], alive)
                hit = np.flatnonzero(spot < b - a)
                hit = hit[row[a:b][spot[hit]] == alive[hit]]
                part[hit] += q[j] * weight[a:b][spot[hit]]
            if len(alive) > 4 * k and j % 4 == 3:
                bound = max(np.partition(part, len(part) - k)[len(part) - k] + less[j + 1], bar)
                near = part + more[j + 1] >= bound
                alive, part = alive[near], part[near]
    if alive is None:
        alive, part = np.arange(n), score
    there = part > FAR // 2
    alive, part = alive[there], part[there]
    if len(part) > k:
        least = np.partition(part, len(part) - k)[len(part) - k]
        alive, part = alive[part >= least], part[part >= least]
    best = np.lexsort((alive, -part))[:k]
    return ids[alive[best]], part[best]


def integers(rows: DataFrame, scale: int = 256, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(row, id, w): floor(scale * x) of each component x, as a whole double, for rows that can take part; row: a number of each row.

    The numbers are written with the rows, so that whatever reads them later sees the same.
    """
    v = F.transform(f"`{vector}`", lambda x: F.lit(float(scale)) * x.cast("double"))
    # below 2^53 a double's floor is a long; from there on doubles are whole
    w = F.transform(v, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = rows.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & fine)
    return cut(ok.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"), w.alias("w")))


def _packed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes, weights and rows of (row, id, w)."""
    lists = table.column("w").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return table.column("id").to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), whole(lists.flatten().to_numpy()), table.column("row").to_numpy()


def _file(folder: str, shard: int):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    return store, posixpath.join(path, f"shard-{shard}")


def top_k(vectors: DataFrame, asking: DataFrame, k: int = 5, shard: int = 4096, block: int = 1024, span: int = 64) -> DataFrame:
    """(asker, query_id, rank, id, score): for each row of `asking` (row, id, w) its k best rows of `vectors` (row, id, w) by inner product.

    asker: the asking row's number; the row of `vectors` of that number isn't its candidate. The index is written once; a
    task reads `span` shards for up to `block` queries, so queries are dealt out once a span and shards never.
    """
    rows, asked = vectors.count(), asking.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    # few queries make small blocks, so that there is a task for each core
    shards, blocks = max(1, -(-rows // shard)), max(1, -(-asked // block), min(cores, -(-asked // 32)))
    spans, folder = -(-shards // span), fresh_dir(vectors.sparkSession, "postings")

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        store, path = _file(folder, key[0].as_py())
        store.create_dir(posixpath.dirname(path))
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part, compression=None) as out:
            out.write(pickle.dumps(postings(*_packed(table))))
        store.move(part, path)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64())})

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, sizes, weights, numbers = _packed(table)
        ends = np.cumsum(sizes)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        first = key[1].as_py() * span
        for x in range(first, min(first + span, shards)):
            store, path = _file(folder, x)
            if store.get_file_info(path).type.name == "NotFound":  # no row fell into it
                continue
            with store.open_input_file(path) as f:
                index = pickle.loads(f.read())
            for i, own in enumerate(numbers.tolist()):
                f, s = best[i]
                g, t = search(index, own, weights[ends[i] - sizes[i] : ends[i]], k, int(s[-1]) if len(s) == k else FAR)
                if len(g):
                    f, s = np.r_[f, g], np.r_[s, t]
                    by = sorted(range(len(s)), key=lambda r: (-int(s[r]), int(f[r])))[:k]
                    best[i] = f[by], s[by]
        n = [len(f) for f, _ in best]
        return pa.table({"asker": np.repeat(numbers, n), "query_id": np.repeat(ids, n), "id": np.concatenate([f for f, _ in best]), "score": np.concatenate([s for _, s in best])})

    dealt = vectors.select("row", "id", "w", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")).groupBy("shard")
    dealt.applyInArrow(build, "shard long").agg(F.count("*")).first()
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long")))
    query = asking.select("row", "id", "w", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).alias("block"), every.alias("span"))
    hits = query.repartition(blocks * spans, "block", "span").groupBy("block", "span").applyInArrow(run, "asker long, query_id long, id long, score long")
    best = W.partitionBy("asker").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("asker", "query_id", "rank", "id", "score")

"""The k best rows of each query, kept in the workers of a task while its part of the table goes by.

A task gives k rows a query at most, so that neither all pairs nor all scores are ever rows. Scores are rounded before
they are compared, and ties go to the smaller key, as in `search.top`, which makes the final choice among the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Scores that a block holds at a time.
CELLS = 1 << 20


def keys_of(column: pa.Array) -> np.ndarray:
    """Keys as numbers where they are, or as objects in their order."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), dtype=object)


class Best:
    """The k best (score, key) of queries 0 to n-1. Missing scores are NaN in `missing` places and come last."""

    def __init__(self, n: int, k: int, least: float = -np.inf) -> None:
        self.n, self.k = n, k
        self.bar = np.full(n, least)
        self.parts: list[tuple] = []
        self.held = self.after = 0

    def add(self, first: int, scores: np.ndarray, keys: np.ndarray, wanted: np.ndarray | None = None, missing: np.ndarray | None = None) -> None:
        """Scores (queries from `first` on, rows). wanted: those that count; missing: rows without a score."""
        order = np.round(scores, 9)
        odd = ~np.isfinite(order)
        if odd.any():  # not a number is above all, as in SQL
            order = np.where(np.isnan(order), np.inf, np.clip(order, -np.finfo(float).max, np.finfo(float).max))
        if missing is not None:
            order[:, missing] = -np.inf
        bar = self.bar[first : first + len(order)]
        mask = order >= bar[:, None]
        if wanted is not None:
            mask &= wanted
        if order.shape[1] > self.k and mask.sum() > 4 * self.k * len(order):
            ranked = order if wanted is None else np.where(wanted, order, -np.inf)
            near = np.partition(ranked, order.shape[1] - self.k, axis=1)[:, order.shape[1] - self.k]
            mask &= order >= near[:, None]
        q, row = np.nonzero(mask)
        if len(q):
            self.parts.append((q + first, order[q, row], keys[row], scores[q, row]))
            self.held += len(q)
            if self.held > self.after + max(self.n * self.k, CELLS // 4):
                self.prune()

    def prune(self) -> None:
        if not self.parts:
            return
        q, order, keys, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        if keys.dtype == object:  # nulls before all other keys
            _, keys_at = np.unique(np.array([(x is not None, x if x is not None else 0) for x in keys] + [None], dtype=object)[:-1], return_inverse=True)
        else:
            keys_at = keys
        at = np.lexsort((keys_at, -order, q))
        starts = np.searchsorted(q[at], np.arange(self.n))
        place = np.arange(len(at)) - starts[q[at]]
        at = at[place < self.k]
        place = place[place < self.k]
        full = at[place == self.k - 1]
        self.bar[q[full]] = np.maximum(self.bar[q[full]], order[full])
        self.parts = [(q[at], order[at], keys[at], scores[at])]
        self.held = self.after = len(at)

    def batches(self, ids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """(query_id, key, score); ids: the queries' own."""
        self.prune()
        for q, order, keys, scores in self.parts:
            for i in range(0, len(q), 1 << 16):
                j = slice(i, i + (1 << 16))
                score = pa.array(scores[j], pa.float64(), mask=np.isneginf(order[j]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[j])), pa.array(keys[j], schema.field(1).type), score], schema=schema)


class Vectors:
    """Lists of numbers as matrices, one for each length; lists that are null or hold a null have length -1."""

    def __init__(self, column: pa.Array) -> None:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if column.type.value_type != pa.float64():
            column = column.cast(pa.list_(pa.float64()))
        flat, n = column.flatten(), len(column)
        sizes = np.zeros(n, np.int64) if not n else column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        values = flat.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))]).astype(np.int64)
        if flat.null_count:
            gone = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
            sizes = np.where(gone[starts[1:]] > gone[starts[:-1]], -1, sizes)
        self.sizes, self.groups = sizes, {}
        for size in np.unique(sizes):
            rows = np.nonzero(sizes == size)[0]
            if size < 0:
                self.groups[-1] = (rows, None)
            elif len(rows) == n:
                self.groups[int(size)] = (rows, values.reshape(n, size))
            else:
                self.groups[int(size)] = (rows, values[starts[rows][:, None] + np.arange(size)].reshape(len(rows), size))


def dense(best: Best, asked: Vectors, n: int, rows: pa.Array, keys: np.ndarray, chunk: int = 2048) -> None:
    """Inner products of all asked vectors with all rows into `best`; vectors of different lengths have none."""
    order = np.concatenate([r for r, _ in asked.groups.values()]) if asked.groups else np.zeros(0, int)
    assert np.array_equal(order, np.arange(n)), "queries are sorted by their lengths"
    for i in range(0, len(rows), chunk):
        part, own = Vectors(rows.slice(i, chunk)), keys[i : i + chunk]
        first = 0
        for size, (qs, q) in asked.groups.items():
            at, v = part.groups.get(size, (np.zeros(0, int), None)) if size >= 0 else (np.zeros(0, int), None)
            missing = np.ones(len(own), bool)
            missing[at] = False
            step = max(CELLS // max(len(own), 1), 1)
            for a in range(0, len(qs), step):
                many = min(step, len(qs) - a)
                if len(at) == len(own):
                    scores = q[a : a + many] @ v.T
                else:
                    scores = np.zeros((many, len(own)))
                    if len(at):
                        scores[:, at] = q[a : a + many] @ v.T
                best.add(first + a, scores, own, missing=missing if missing.any() else None)
            first += len(qs)


class Weights:
    """Weights of (query, term) in blocks of queries: (first query, queries, places of their terms, matrix of terms x queries)."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, cells: int = CELLS) -> None:
        at = np.argsort(query, kind="stable")
        query, term, weight = query[at], term[at], weight[at]
        ends = np.searchsorted(query, np.arange(n), side="right")
        self.blocks = []
        first = start = 0
        while first < n:
            last = first + 1
            seen = set(term[start : ends[first]].tolist())
            while last < n:
                more = seen.union(term[ends[last - 1] : ends[last]].tolist())
                if len(more) * (last + 1 - first) > cells:
                    break
                seen, last = more, last + 1
            terms = np.array(sorted(seen), np.int64)
            matrix = np.zeros((len(terms), last - first))
            own = slice(start, ends[last - 1])
            np.add.at(matrix, (np.searchsorted(terms, term[own]), query[own] - first), weight[own])
            self.blocks.append((first, last - first, terms, matrix))
            first, start = last, ends[last - 1]


def sparse(best: Best, weights: Weights, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, terms: int, k1: float, b: float, avgdl: float) -> None:
    """BM25 scores of documents into `best`. ids: their tokens' places among the asked `terms` one after the other, -1 for others; sizes: tokens of each document."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    code, tf = np.unique((doc * terms + ids)[ids >= 0], return_counts=True)
    doc, term = code // max(terms, 1), code % max(terms, 1)
    value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / avgdl))
    for first, many, own, matrix in weights.blocks:
        place = np.minimum(np.searchsorted(own, term), max(len(own) - 1, 0))
        at = np.nonzero(own[place] == term)[0] if len(own) else np.zeros(0, int)
        if not len(at):
            continue
        step = max(1, CELLS // max(len(own), many))
        for d in range(0, len(sizes), step):
            here = at[(doc[at] >= d) & (doc[at] < d + step)]
            if len(here):
                n = min(step, len(sizes) - d)
                table = np.zeros((n, len(own)))
                table[doc[here] - d, place[here]] = value[here]
                scores = (table @ matrix).T
                best.add(first, scores, keys[d : d + n], wanted=scores > 0)

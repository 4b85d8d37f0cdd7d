"""An interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Tokens are a text's words in ASCII lower case and one end. Workers count the pairs (token before, token) of
their rows; the counts, packed by ranges of hashes, meet in one shuffle and are merged range by range. Each
range becomes a file of sorted 64-bit hashes with counts in the shared folder: pairs; and tokens with their
counts, continuation counts (how many tokens they follow) and the pairs they begin that were seen once, twice
and more often. Scoring maps the files and looks up a batch's distinct hashes in order.

p(w | v) = max(c(vw) - D, 0) / c(v) + g(v) p(w);  p(w) = max(n(w) - D', 0) / pairs + g' / (V + 1)

with n(w) the continuation count, D and D' the three discounts of each order from its counts of counts, and
g, g' what they leave; the uniform part holds one unseen token. After an unseen token p(w) holds.

Null and blank texts are one end; very long texts are counted and scored whole; an empty table gives no rows; columns
other than the key and the text play no part, whatever their names. Rows of a null id don't teach and aren't held out; repeated rows count
and are scored each. With nothing to learn from every text scores 0.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh_dir

U = np.uint64


class Hashes(dict):
    """Token to 64-bit hash; emptied when full."""

    def __init__(self, most: int = 500_000) -> None:
        self.most = most

    def __missing__(self, token: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.most:
            self.clear()
        out = self[token] = xxh64_intdigest(token)
        return out


#: Names that no word has, for the end and for what stands before the first token.
END, START = Hashes()[b" end"], Hashes()[b" start"]


def tokens(text: str | None, hashes: Hashes) -> np.ndarray:
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, U)
    out[:-1] = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    out[-1] = END
    return out


def before(toks: np.ndarray) -> np.ndarray:
    return np.r_[U(START), toks[:-1]]


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A pair's hash: 16 bits of the first token's, so that ranges hold all pairs of a token, and 48 of both."""
    x = (v * U(0x9E3779B97F4A7C15)) ^ w
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return (v & U(0xFFFF << 48)) | (x >> U(16))


def part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range that a token's (or, by the same bits, a pair's) hash is in."""
    return ((hashes >> U(48)) * U(parts) >> U(16)).astype(np.int64)


def _sums(keys: tuple[np.ndarray, ...], counts: list[np.ndarray]) -> tuple[tuple[np.ndarray, ...], list[np.ndarray]]:
    """Distinct keys in order of the first, then the others, with their counts summed."""
    if not len(keys[0]):
        return keys, counts
    by = np.lexsort(keys[::-1])
    keys = tuple(k[by] for k in keys)
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), [np.add.reduceat(c[by], at) for c in counts]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in the least width that holds each."""
    out = [np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()]
    for a in arrays:
        width = 8 if a.dtype == U else next(b for b in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * b)
        out += [bytes([width]), a.astype(f"<u{width}").tobytes()]
    return b"".join(out)


def _unpack(data) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(data, np.int64, n, 8), 8 * (n + 1), []
    for size in sizes:
        width = data[at]
        out.append(np.frombuffer(data, f"<u{width}", int(size), at + 1))
        at += 1 + width * int(size)
    return out


def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays one behind the other, 8 bytes a number for hashes, 4 or 8 for counts; moved into place when whole."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    temp = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as out:
        out.write(np.array([len(arrays[0])], np.int64).tobytes())
        for a in arrays:
            out.write(a.tobytes())
    store.move(temp, f"{path}/{name}")


#: Counts of 32 bits stop here; scores see no difference. Bytes of text that a range of the model comes from.
LARGEST, RANGE = (1 << 32) - 1, 64 << 20
PAIR = (("key", "<u8"), ("count", "<u4"))
TOKEN = (("key", "<u8"), ("count", "<u8"), ("follows", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"))


def _map(folder: str, name: str, fields) -> dict[str, np.ndarray] | None:
    """A file's arrays, memory-mapped; from a store without local paths by way of a nameless copy."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    if isinstance(store, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        fd, copy = tempfile.mkstemp()
        os.close(fd)
        fs.copy_files(path, copy, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        raw = np.memmap(copy, np.uint8, "r")
        os.unlink(copy)
    n, at, out = int(raw[:8].view(np.int64)[0]), 8, {}
    for field, kind in fields:
        size = n * np.dtype(kind).itemsize
        out[field] = raw[at : at + size].view(kind)
        at += size
    return out


@dataclass(frozen=True)
class Model:
    """folder, parts: where the arrays are; tokens: N; types: V; pairs: distinct pairs; d1, d2: discounts for counts of
    1, 2 and more, of pairs and of continuation counts; left: the share of probability that d2 leaves."""

    folder: str
    parts: int
    tokens: int
    types: int
    pairs: int
    d2: tuple[float, float, float]
    d1: tuple[float, float, float]
    left: float


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Those of modified Kneser-Ney from the counts of counts 1 to 4; where they don't exist, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


STATS = ["tokens", "types", "pairs", "p1", "p2", "p3", "p4", "u1", "u2", "u3", "u4"]


def train(docs: DataFrame, text: str = "text", parts: int | None = None, flush: int = 4_000_000) -> Model:
    """The model of all rows of `docs`. parts: ranges of hashes, by default one for each RANGE bytes of text, and the session's shuffle partitions at least."""
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(f"`{text}`").cast("long")), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    parts = min(parts, 1 << 16)
    folder = fresh_dir(spark, "kneser-ney")
    folder = folder if "://" in folder else "file://" + folder

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Hashes(), [], 0

        def out():
            toks = np.concatenate(held)
            last = np.concatenate([before(t) for t in held])
            (v, w), (c,) = _sums((last, toks), [np.ones(len(toks), np.int64)])
            edge = np.searchsorted(part(v, parts), np.arange(parts + 1))
            rows = [(p, a, b) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
            for p, a, b in rows:  # a row at a time: they are packed ones
                own, at, n = np.unique(v[a:b], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_pack(own, n, w[a:b], c[a:b])], pa.binary())], ["part", "packed"])

        for b in batches:
            for t in b.column(0):
                held.append(tokens(t.as_py(), hashes))
                size += len(held[-1])
                if size >= flush:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A range's pairs: their file is written, what their tokens need goes to the tokens' ranges."""
        p, vs, ws, cs = key[0].as_py(), [], [], []
        for x in table.column("packed"):
            own, n, w, c = _unpack(x.as_buffer())
            vs.append(np.repeat(own, n.astype(np.int64)))
            ws.append(w)
            cs.append(c.astype(np.int64))
        (v, w), (c,) = _sums((np.concatenate(vs), np.concatenate(ws)), [np.concatenate(cs)])
        del vs, ws, cs
        keys = pair_key(v, w)
        by = np.argsort(keys)
        _write(folder, f"pairs-{p}", keys[by], np.minimum(c[by], LARGEST).astype("<u4"))
        del keys, by
        at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (c, c == 1, c == 2, c > 2)]
        counts = [int((c == k).sum()) for k in (1, 2, 3, 4)]
        ends = int(c[w == U(END)].sum())
        rows = [(p, "v", _pack(v[at], *sums))]
        if ends:
            zero = np.zeros(1, np.int64)
            rows.append((int(part(np.array([END], U), parts)[0]), "v", _pack(np.array([END], U), zero + ends, zero, zero, zero)))
        w, n = np.unique(w, return_counts=True)
        edge = np.searchsorted(part(w, parts), np.arange(parts + 1))
        rows += [(q, "w", _pack(w[a:b], n[a:b])) for q, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        out = {"part": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows]), "packed": pa.array([r[2] for r in rows], pa.binary())}
        return pa.table(out | {f"p{k}": pa.array([n if i == 0 else 0 for i in range(len(rows))], pa.int64()) for k, n in zip((1, 2, 3, 4), counts, strict=True)})

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A range's tokens: their file, and the sums over it."""
        p, keys, cols = key[0].as_py(), [], [[], [], [], [], []]
        for kind, x in zip(table.column("kind").to_pylist(), table.column("packed"), strict=True):
            k, *rest = (a.astype(np.int64) if i else a for i, a in enumerate(_unpack(x.as_buffer())))
            zero = np.zeros(len(k), np.int64)
            keys.append(k)
            for col, a in zip(cols, [rest[0], zero, *rest[1:]] if kind == "v" else [zero, rest[0], zero, zero, zero], strict=True):
                col.append(a)
        (k,), (c, follows, n1, n2, n3) = _sums((np.concatenate(keys),), [np.concatenate(x) for x in cols])
        _write(folder, f"tokens-{p}", k, c.astype("<u8"), *(np.minimum(x, LARGEST).astype("<u4") for x in (follows, n1, n2, n3)))
        real = k != U(START)
        stats = [int(c[real].sum()), int(real.sum()), int(follows.sum()), *(sum(table.column(f"p{i}").to_pylist()) for i in (1, 2, 3, 4)), *(int((follows == i).sum()) for i in (1, 2, 3, 4))]
        return pa.table({n: pa.array([x], pa.int64()) for n, x in zip(STATS, stats, strict=True)})

    counted = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "part int, packed binary")
    merged = counted.groupBy("part").applyInArrow(merge, "part int, kind string, packed binary, p1 long, p2 long, p3 long, p4 long")
    done = merged.groupBy("part").applyInArrow(finish, ", ".join(f"{n} long" for n in STATS)).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in STATS]).first()
    d2, d1 = discounts([done[f"p{k}"] for k in (1, 2, 3, 4)]), discounts([done[f"u{k}"] for k in (1, 2, 3, 4)])
    many = done["types"] - done["u1"] - done["u2"]
    left = (d1[0] * done["u1"] + d1[1] * done["u2"] + d1[2] * many) / done["pairs"] if done["pairs"] else 1.0
    return Model(folder, parts, done["tokens"], done["types"], done["pairs"], d2, d1, left)


class Reader:
    """A worker's view of a model."""

    def __init__(self, model: Model) -> None:
        self.model, self.hashes = model, Hashes()
        self.files: dict[str, dict | None] = {}

    def look(self, name: str, fields, keys: np.ndarray) -> dict[str, np.ndarray]:
        """The fields of sorted keys; 0 where a key isn't there."""
        out = {f: np.zeros(len(keys), np.int64) for f, _ in fields[1:]}
        edge = np.searchsorted(part(keys, self.model.parts), np.arange(self.model.parts + 1))
        for p in np.flatnonzero(edge[1:] > edge[:-1]):
            file = f"{name}-{p}"
            if file not in self.files:
                self.files[file] = _map(self.model.folder, file, fields)
            if (f := self.files[file]) is None or not len(f["key"]):
                continue
            own = keys[edge[p] : edge[p + 1]]
            spot = np.minimum(np.searchsorted(f["key"], own), len(f["key"]) - 1)
            hit = f["key"][spot] == own
            for x in out:
                out[x][edge[p] : edge[p + 1]][hit] = f[x][spot[hit]]
        return out

    def score(self, texts: list[str | None]) -> list[np.ndarray]:
        """n_tokens, n_known, base, score of each text."""
        m = self.model
        toks = [tokens(t, self.hashes) for t in texts]
        size = np.array([len(t) for t in toks])
        start = np.r_[0, np.cumsum(size)[:-1]]
        w, v = np.concatenate(toks), np.concatenate([before(t) for t in toks])
        own, back = np.unique(np.r_[w, U(START)], return_inverse=True)
        one = self.look("tokens", TOKEN, own)
        wi = back[:-1]
        vi = np.r_[back[-1], wi[:-1]]
        vi[start] = back[-1]
        pairs, pair = np.unique(pair_key(v, w), return_inverse=True)
        both = self.look("pairs", PAIR, pairs)["count"][pair]
        less = lambda c, d: np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)
        low = (less(one["follows"], m.d1) / max(m.pairs, 1) + m.left / (m.types + 1))[wi]
        count = one["count"]
        rest = np.where(count > 0, (m.d2[0] * one["n1"] + m.d2[1] * one["n2"] + m.d2[2] * one["n3"]) / np.maximum(count, 1), 1.0)[vi]
        p = less(both, m.d2) / np.maximum(count, 1)[vi] + rest * low
        c = count[wi]
        base = np.log10((c + 1) / (m.tokens + m.types + 1))
        return [size, np.add.reduceat((c > 0).astype(np.int64), start), np.add.reduceat(base, start), np.add.reduceat(np.log10(p), start)]


_READERS: dict[Model, Reader] = {}


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score): every row; about `most` words, or one text, are looked up at once."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _READERS:
            _READERS.clear()
            _READERS[model] = Reader(model)
        reader = _READERS[model]

        def out(keys, texts):
            cols = reader.score(texts)
            return pa.RecordBatch.from_arrays([keys, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3])], ["key", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            first, size, texts = 0, 0, []
            for i, t in enumerate(b.column(1)):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= 6 * most:
                    yield out(b.column(0).slice(first, len(texts)), texts)
                    first, size, texts = i + 1, 0, []
            if texts:
                yield out(b.column(0).slice(first, len(texts)), texts)

    got = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, n_known long, base_score double, score double")
    return got.withColumnRenamed("key", key)

"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Merges come from an agenda, best score first and leftmost among equals. A candidate that comes up is skipped
for good if a hash of (seed, document, unit's place in the text, candidate's place in the unit, its length and piece)
falls under `dropout`; what its neighbours become may put other candidates on the agenda. So every occurrence of
every word has draws of its own. The pieces left are those of the vocabulary, others fall back to bytes, so every
segmentation decodes to the text it came from. dropout 0 gives the library's own ids.

A text is cut where no piece of the vocabulary can reach across (before blanks, around line ends); the units
are encoded apart. The agenda of a unit is a tree: a node has the ids that come of it when nothing more is skipped and
the candidates that come up on that way; skipping one of these leads to a child. Nodes are made as they are asked for,
many at a time, and kept by a worker up to `cached` units and `nodes` nodes; then it forgets all of them. An occurrence
draws for a node's candidates until its first skip, goes to that child, and so on: what is kept changes no result.

A null text has no ids and decodes to the empty text; an empty text has none either; rows are encoded apart,
repeated ones alike; a literal U+2581 becomes bytes, so it isn't read as a blank. A null id is a key like any other.
Units of over `SHORT` characters, as in very long texts without blanks, go through an agenda of their own each. An empty
table gives no rows; columns other than the id and the text play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tessera.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_M = (1 << 64) - 1
#: Longest units whose agendas move together; longer ones go one by one.
SHORT = 48


def mix(x: int) -> int:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M
    return x ^ x >> 31


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Dropout:
    rate: float = 0.1
    seed: int = 1
    cached: int = 250_000
    nodes: int = 1_000_000


def load(path: str = MODEL) -> list[tuple[str, float, bool]]:
    """(piece, score, whether it is a byte) by id; control pieces are the empty string."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: p.is_control(i) or p.is_unknown(i) or p.is_unused(i)
    return [("" if odd(i) else p.id_to_piece(i), p.get_score(i), p.is_byte(i)) for i in range(p.get_piece_size())]


class Pairs:
    """An open-addressed table from two symbols to the rank of what they merge to."""

    BITS, NONE = 20, np.int32(2**31 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.keys, self.ranks = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, self.NONE, np.int32)
        for key, r in zip((left.astype(np.int64) << 20 | right).tolist(), rank.tolist(), strict=True):
            at = (key * 0x9E3779B97F4A7C15 & _M) >> 64 - self.BITS
            while self.keys[at] >= 0:
                at = at + 1 & (1 << self.BITS) - 1
            self.keys[at], self.ranks[at] = key, r

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; NONE for pairs that don't merge or hold a negative symbol."""
        key = left.astype(np.int64) << 20 | right
        key[(left < 0) | (right < 0)] = -2
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)
        found = self.keys[at]
        out = self.ranks[at]
        out[found != key] = self.NONE
        left_over = np.flatnonzero((found != key) & (found >= 0))
        while len(left_over):
            at[left_over] = at[left_over] + 1 & (1 << self.BITS) - 1
            found = self.keys[at[left_over]]
            hit = found == key[left_over]
            out[left_over[hit]] = self.ranks[at[left_over[hit]]]
            left_over = left_over[~hit & (found >= 0)]
        return out


class Grown:
    """An array that is added to; `all` is what it holds."""

    def __init__(self, kind) -> None:
        self.room, self.size = np.zeros(1024, kind), 0

    def __len__(self) -> int:
        return self.size

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, new: np.ndarray) -> None:
        if (more := self.size + len(new)) > len(self.room):
            self.room = np.r_[self.all, np.zeros(max(more, len(self.room) * 3 // 2) - self.size, self.room.dtype)]
        self.room[self.size : more] = new
        self.size = more


def masked(mask: int) -> Callable[[int, int], bool]:
    """Skips at the steps whose bits are set."""
    return lambda step, code: bool(mask >> step & 1)


def drawn_by(key: int, limit: int) -> Callable[[int, int], bool]:
    """Skips by an occurrence's draws."""
    return lambda step, code: (code * key + (key >> 1) & _M) < limit


class Units(dict):
    """Numbers of units, given as they are asked for."""

    def __init__(self) -> None:
        self.names: list[str] = []

    def __missing__(self, unit: str) -> int:
        out = self[unit] = len(self.names)
        self.names.append(unit)
        return out


@dataclass
class Encoder:
    vocab: list[tuple[str, float, bool]]
    dropout: Dropout = Dropout()

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, _, byte) in enumerate(self.vocab) if p and not byte}
        order = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-self.vocab[i][1], i))
        self.rank = {self.vocab[i][0]: r for r, i in enumerate(order)}
        self.merged = np.array(order, np.int32)
        # symbols are the pieces, and characters of pieces that are none themselves
        symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            symbols.setdefault(c, len(self.vocab) + len(symbols))
        pairs = [(symbols[p[:i]], symbols[p[i:]], r) for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols]
        self.pairs = Pairs(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
        self.char = np.full(0x110000, -1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        # a blank is the block sign's symbol, a literal block sign none
        self.char[ord(" ")], self.char[ord(BLANK)] = self.char[ord(BLANK)], -1
        self.byte = [0] * 256
        for i, (p, _, byte) in enumerate(self.vocab):
            if byte:
                self.byte[int(p[3:5], 16)] = i
        self.raw = [(bytes([int(p[3:5], 16)]) if byte else p.replace(BLANK, " ").encode()) for p, _, byte in self.vocab]
        inner = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        lines = any("\n" in p for p in self.ids if len(p) > 1)
        # a unit: blanks and what follows up to the next blank; the whole text where pieces reach across blanks
        self.unit = re.compile(r"(?s).+" if inner else r" *[^ ]+| +" if lines else r"\n| *[^ \n]+| +")
        self.limit = min(int(self.dropout.rate * 2**64), _M)
        self._forget()

    def _forget(self) -> None:
        """Empties what is kept: the units' numbers and roots, the nodes, their ids and candidates."""
        self.known, self.root = Units(), Grown(np.int32)
        #: by node: its unit, its skips as bits by agenda step, the step of its first candidate, where its ids and candidates are
        self.unit_of, self.mask, self.low, self.id_at, self.id_n, self.at, self.n = (Grown(t) for t in (np.int32, np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64))
        #: of all nodes: ids; candidates, and the child that skipping one leads to (-1 unmade, -2 beyond the bits)
        self.data, self.codes, self.child = Grown(np.int32), Grown(np.uint64), Grown(np.int32)

    def _add(self, numbers: np.ndarray, masks: np.ndarray, lows: np.ndarray) -> np.ndarray:
        """Makes nodes of units (by number) with the given skips; gives their numbers."""
        got, codes, n = self.many([self.known.names[i] for i in numbers.tolist()], masks, lows)
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        first = len(self.mask)
        for kept, new in ((self.unit_of, numbers), (self.mask, masks), (self.low, lows), (self.id_at, len(self.data) + np.cumsum(size) - size), (self.id_n, size), (self.at, len(self.codes) + np.cumsum(n) - n), (self.n, n)):
            kept.add(new)
        self.data.add(np.frombuffer(b"".join(got), np.int32))
        self.codes.add(codes)
        self.child.add(np.full(len(codes), -1, np.int32))
        return np.arange(first, first + len(numbers))

    def _children(self, spots: np.ndarray) -> None:
        """Makes the children that skipping the candidates at `spots` leads to."""
        parent = np.searchsorted(self.at.all, spots, side="right") - 1
        step = self.low.all[parent] + spots - self.at.all[parent]
        fits = step < 64
        self.child.all[spots[~fits]] = -2
        spots, parent, step = spots[fits], parent[fits], step[fits]
        if len(spots):
            self.child.all[spots] = self._add(self.unit_of.all[parent], self.mask.all[parent] | np.uint64(1) << step.astype(np.uint64), step + 1)

    def _follow(self, node: np.ndarray, key: np.ndarray) -> None:
        """Moves occurrences from their units' roots (in `node`) to where their draws lead; -2 where bits don't reach."""
        limit, active = np.uint64(self.limit), np.arange(len(node))
        while len(active):
            n = self.n.all[node[active]]
            stop = np.cumsum(n)
            spot = np.repeat(self.at.all[node[active]] - stop + n, n) + np.arange(stop[-1])
            k = np.repeat(key[active], n)
            skip = np.flatnonzero(self.codes.all[spot] * k + (k >> np.uint64(1)) < limit)
            if not len(skip):
                return
            whose = np.searchsorted(stop, skip, side="right")
            first = np.r_[True, whose[1:] != whose[:-1]]
            whose, spot = whose[first], spot[skip[first]]
            if len(new := np.unique(spot[self.child.all[spot] == -1])):
                self._children(new)
            to = self.child.all[spot]
            node[active[whose]] = to
            active = active[whose][to >= 0]

    def many(self, units: list[str], masks: np.ndarray, lows: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of units whose agenda skips the steps in `masks`: packed 32-bit ids; the candidates from step `lows` on; how many each has.

        All agendas move a step at a time.
        """
        out: list[bytes] = [b""] * len(units)
        by_size: dict[int, list[int]] = {}
        seen: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for n, u in enumerate(units):
            if len(u) > SHORT:
                out[n] = self.one(u, masked(int(masks[n])))
            else:
                by_size.setdefault(max(4, len(u) + 3 & ~3), []).append(n)
        for width, rows in by_size.items():
            for i in range(0, len(rows), 1 << 16):
                self._step(width, rows[i : i + (1 << 16)], units, masks, lows, out, seen)
        whose, codes = (np.concatenate(c) for c in zip(*seen, strict=True))
        return out, codes[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(units))

    def _step(self, width: int, rows: list[int], units: list[str], masks: np.ndarray, lows: np.ndarray, out: list[bytes], seen: list) -> None:
        none, look, cols = Pairs.NONE, self.pairs.look, width + 2
        texts = [units[n] for n in rows]
        points = np.frombuffer("".join([u.ljust(width, "\0") for u in texts]).encode("utf-32-le"), np.uint32).reshape(-1, width)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        # a column of nothing on either side, so that neighbours are always there
        sym = np.full((len(rows), cols), -2, np.int32)
        sym[:, 1:-1] = np.where(np.arange(width) < size[:, None], self.char[points], -2)
        rank = np.full((len(rows), cols), none, np.int32)
        rank[:, 1:-2] = look(sym[:, 1:-2].ravel(), sym[:, 2:-1].ravel()).reshape(len(rows), width - 1)
        after = np.tile(np.arange(1, cols + 1, dtype=np.int32), (len(rows), 1))
        ahead = np.tile(np.arange(-1, cols - 1, dtype=np.int32), (len(rows), 1))
        merged, number, step = self.merged, np.arange(len(rows)), 0
        own = np.array(rows)
        mask, low_step = masks[own], lows[own]
        done = [None] * len(rows)

        def finish(which: np.ndarray) -> None:
            part = sym[which]
            flat = part[part != -2]
            ends = np.cumsum((part != -2).sum(1))
            if (flat < 0).any() or (flat >= len(self.vocab)).any():
                for r, n in zip(which, number[which], strict=True):
                    done[n] = self.one(texts[n], masked(int(masks[rows[n]]))) if ((sym[r] == -1) | (sym[r] >= len(self.vocab))).any() else sym[r][sym[r] != -2].tobytes()
                return
            data = flat.tobytes()
            for n, a, b in zip(number[which].tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                done[n] = data[4 * a : 4 * b]

        while len(number):
            best = rank.argmin(1)
            low = rank[np.arange(len(rank)), best]
            rest = low != none
            if rest.mean() < 0.75:
                finish(np.flatnonzero(~rest))
                sym, rank, after, ahead, mask, low_step, number, best, low = (x[rest] for x in (sym, rank, after, ahead, mask, low_step, number, best, low))
                if not len(number):
                    break
                act = np.arange(len(number))
            else:
                act = np.flatnonzero(rest)
                best, low = best[act], low[act]
            s, r, nx, pv = sym.reshape(-1), rank.reshape(-1), after.reshape(-1), ahead.reshape(-1)
            base = act * cols
            at = base + best
            right = base + nx[at]
            far = nx[right]
            if self.limit:
                open_ = low_step[act] <= step
                candidate = (best.astype(np.uint64) - np.uint64(1)) << np.uint64(40) | (far - best).astype(np.uint64) << np.uint64(20) | low.astype(np.uint64)
                seen.append((own[number[act[open_]]], candidate[open_]))
                skip = (mask[act] >> np.uint64(step) & np.uint64(1)).astype(bool) if step < 64 else np.zeros(len(act), bool)
                r[at[skip]] = none
                go = ~skip
                base, at, right, far, best, low = base[go], at[go], right[go], far[go], best[go], low[go]
                step += 1
            s[at] = merged[low]
            s[right], r[right] = -2, none
            nx[at] = far
            pv[base + far] = best
            r[at] = look(s[at], s[base + far])
            left = base + pv[at]
            r[left] = look(s[left], s[at])
        for n, x in zip(rows, done, strict=True):
            out[n] = x

    def one(self, unit: str, skips: Callable[[int, int], bool] | None = None) -> bytes:
        """A unit's ids as packed 32-bit numbers; skips: whether the candidate that comes up at a step is skipped."""
        # a literal block sign can't merge: it stands as an empty symbol until bytes are made of it
        text = ["" if c == BLANK else BLANK if c == " " else c for c in unit]
        rank, step = self.rank, -1
        n = len(text)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if text[i] and text[i + 1] and (p := rank.get(text[i] + text[i + 1])) is not None:
                agenda.append((p, i, i + 1, 2))
        heapify(agenda)
        while agenda:
            p, i, j, size = heappop(agenda)
            if not text[i] or after[i] != j or len(text[i]) + len(text[j]) != size or not text[j]:
                continue
            step += 1
            if skips is not None and skips(step, i << 40 | size << 20 | p):
                continue
            text[i] += text[j]
            text[j] = ""
            k = after[i] = after[j]
            if k < n:
                ahead[k] = i
                if text[k] and (q := rank.get(text[i] + text[k])) is not None:
                    heappush(agenda, (q, i, k, len(text[i]) + len(text[k])))
            h = ahead[i]
            if h >= 0 and text[h] and (q := rank.get(text[h] + text[i])) is not None:
                heappush(agenda, (q, h, i, len(text[h]) + len(text[i])))
        out, i = [], 0
        while i < n:
            piece = text[i] or BLANK
            p = self.ids.get(text[i]) if text[i] else None
            if p is not None:
                out.append(p)
            else:
                out += [self.byte[b] for b in (BLANK.encode() if not text[i] else piece.replace(BLANK, " ").encode())]
            i = after[i]
        return np.array(out, np.int32).tobytes()

    def encode_all(self, texts: list[str | None], keys: list[int], piece: int = 1 << 18) -> list[np.ndarray]:
        """The ids of texts; a key is its document's, so that equal words are cut unlike in different texts and places."""
        seed = self.dropout.seed * 0x9E3779B97F4A7C15
        if len(self.known) > self.dropout.cached or len(self.mask) > self.dropout.nodes:
            self._forget()
        units, ends, drawn = [], [0], [np.zeros(0, np.uint64)]
        for t, key in zip(texts, keys, strict=True):
            if t:
                units += self.unit.findall(" " + t)
            n, base = len(units) - ends[-1], np.uint64(mix((seed ^ mix(key & _M)) & _M))
            drawn.append(mixed(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + base) | np.uint64(1))
            ends.append(len(units))
        number, draw, out = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units)), np.concatenate(drawn), [np.zeros(0, np.int32)]
        self.root.add(np.full(len(self.known) - len(self.root), -1, np.int32))
        todo = np.unique(number[self.root.all[number] < 0])
        if len(todo):
            self.root.all[todo] = self._add(todo, np.zeros(len(todo), np.uint64), np.zeros(len(todo), np.int64))
        sizes = [np.zeros(0, np.int64)]
        for i in range(0, len(units), piece):
            node, key, extra = self.root.all[number[i : i + piece]].astype(np.int64), draw[i : i + piece], Grown(np.int32)
            if self.limit:
                self._follow(node, key)
                node[np.fromiter((len(u) > SHORT for u in units[i : i + piece]), bool, len(node))] = -2
            alone = np.flatnonzero(node == -2)
            size, at = self.id_n.all[node], self.id_at.all[node]
            for j in alone.tolist():
                got = np.frombuffer(self.one(units[i + j], drawn_by(int(key[j]), self.limit)), np.int32)
                size[j], at[j] = len(got), len(self.data) + len(extra)
                extra.add(got)
            data = np.concatenate([self.data.all, extra.all]) if len(alone) else self.data.all
            stop = np.cumsum(size)
            out.append(data[np.repeat(at - stop + size, size) + np.arange(stop[-1])])
            sizes.append(size)
        ids = np.concatenate(out)
        edge = np.r_[0, np.cumsum(np.concatenate(sizes))][ends]
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def encode(self, text: str | None, key: int = 0) -> np.ndarray:
        return self.encode_all([text], [key])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]


_ENCODERS: dict[tuple, Encoder] = {}


def digest(vocab) -> str:
    """Of a whole vocabulary."""
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(repr(vocab).encode())


def _encoder(vocab, named: str, dropout: Dropout) -> Encoder:
    """A worker's encoder for the vocabulary of that digest, kept over its tasks."""
    key = (named, dropout)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocab, dropout)
    return _ENCODERS[key]


def encoded(docs: DataFrame, dropout: Dropout = Dropout(), model: str = MODEL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, lossless): every row of `docs`; lossless: its ids decode to its text.

    The model is read on the driver; its pieces, a table of fixed size, go to the workers with the function.
    """
    vocab = load(model)
    named = digest(vocab)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(vocab, named, dropout)
        for b in slices(batches, 256):
            texts = [t or "" for t in b.column(2).to_pylist()]
            ids = e.encode_all(texts, [k or 0 for k in b.column(1).to_pylist()])
            same = pa.array([e.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)])
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), lists, same], ["key", "n_tokens", "ids", "lossless"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{key}`").cast("string")).alias("salt"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids array<int>, lossless boolean").withColumnRenamed("key", key)


def decoded(tokens: DataFrame, model: str = MODEL, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) of rows with ids; null ids give the empty text."""
    vocab = load(model)
    named, kind = digest(vocab), tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(vocab, named, Dropout())
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["key", "text"])

    return tokens.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)

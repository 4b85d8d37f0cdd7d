"""SimHash near-duplicates by an inverted index over fingerprint bytes and their positions.

A fingerprint has 8 bytes. If two differ in at most 4 bits, at least 4 bytes are equal in place. The index
posts every distinct fingerprint under (three positions, their three bytes), for a set of position triples
such that any 4 positions hold one: a pair that reaches the minimum of 4 shared bytes meets in a posting.
Single bytes would post 1/256 of all fingerprints together. In a posting the shared positional bytes of
pairs are tallied, pairs with fewer than 4 dropped and the rest verified by their differing bits.

A posting is walked as a graph, nearest first, so it returns links that join all it links, and no more of
them than fingerprints; postings above `split` fingerprints are dealt over pairs of blocks. Components come
from alternating star joins over these links.

`near_copies` adds all pairs whose five-word shingles overlap by `SIM` or more, found by prefix filtering and verified.

Odd rows: a null or blank text has the fingerprint zero, which links like any other; equal fingerprints are
one component, whatever their texts; rows of a null key get a fingerprint, and the component of it, but
never name one; repeated rows each get a row. Very long texts are hashed in pieces. An empty table gives no rows;
columns other than the key and the text play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, hot_join, slices, small_batches

BYTES, BITS = 8, 4
#: Shared positional bytes that a pair within BITS has at least.
LEAST = BYTES - BITS


def _triples() -> list[tuple[int, ...]]:
    """Position triples of which every 4 of the 8 positions hold one, chosen greedily."""
    open_, out = set(combinations(range(BYTES), LEAST)), []
    while open_:
        best = max(combinations(range(BYTES), 3), key=lambda t: (sum(set(t) <= set(q) for q in open_), [-x for x in t]))
        out.append(best)
        open_ = {q for q in open_ if not set(best) <= set(q)}
    return out


TRIPLES = _triples()


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, piece: int = 1 << 16) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        joined = iter((b" ".join(words),))
        n = 1
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxh64_intdigest, joined, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, piece):
        ones += np.unpackbits(hashes[i : i + piece].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(key long, fp long): the fingerprint's bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = np.array([fingerprint(x.as_py(), shingle, seed) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["key", "fp"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "key long, fp long")


def walk(fps: np.ndarray, ids: np.ndarray, bits: int = BITS) -> tuple[list[int], list[int]]:
    """Links (as ids) that join all fingerprints of a posting which are linked in it; a forest.

    Each step tallies the bytes that one fingerprint shares, by place, with those not reached yet, drops those
    under the minimum and verifies the rest.
    """
    left, right = [], []
    rest, rest_ids = fps, ids
    while len(rest) > 1:
        edge, edge_ids = [rest[0]], [rest_ids[0]]
        rest, rest_ids = rest[1:], rest_ids[1:]
        while edge and len(rest):
            one, one_id = edge.pop(), edge_ids.pop()
            apart = rest ^ one
            shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
            near = shared >= BYTES - bits
            near[near] = np.bitwise_count(apart[near]) <= bits
            if near.any():
                found = rest_ids[near]
                left.extend([int(one_id)] * len(found))
                right.extend(found.tolist())
                edge.extend(rest[near])
                edge_ids.extend(found)
                rest, rest_ids = rest[~near], rest_ids[~near]
    return left, right


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, pair, fp, id), each posting's rows together, to links (a, b)."""

    def linked(keys, pairs, fps, ids):
        a, b = [], []
        ends = np.flatnonzero((keys[1:] != keys[:-1]) | (pairs[1:] != pairs[:-1])) + 1
        for i, j in zip(np.r_[0, ends], np.r_[ends, len(keys)], strict=True):
            if j - i == 2:  # most postings
                x = int(fps[i] ^ fps[i + 1])
                if sum(x >> s & 255 == 0 for s in range(0, 64, 8)) >= LEAST and x.bit_count() <= BITS:
                    a.append(int(ids[i]))
                    b.append(int(ids[i + 1]))
            elif j - i > 2:
                p, q = walk(fps[i:j], ids[i:j])
                a += p
                b += q
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    kept: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cols = (cols[0], cols[1], cols[2].astype(np.int64).view(np.uint64), cols[3])
        if not len(cols[0]):
            continue
        change = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        last = change[-1] + 1 if len(change) else 0  # the last posting may go on in the next batch
        if last or (kept and (kept[-1][0][-1], kept[-1][1][-1]) != (cols[0][0], cols[1][0])):
            whole = [*kept, tuple(c[:last] for c in cols)]
            yield linked(*(np.concatenate(c) for c in zip(*whole, strict=True)))
            kept = []
        kept.append(tuple(c[last:] for c in cols))
    if kept:
        yield linked(*(np.concatenate(c) for c in zip(*kept, strict=True)))


def links(fps: DataFrame, split: int = 50_000) -> DataFrame:
    """(a, b): ids of distinct fingerprints (columns fp, id) within BITS bits, enough of them to join all that are linked."""
    byte = [F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)]
    posts = F.array(*[F.lit(t << 24) + byte[i] * 65536 + byte[j] * 256 + byte[k] for t, (i, j, k) in enumerate(TRIPLES)])
    posted = fps.select("fp", "id", F.explode(posts).alias("post"))
    sizes = posted.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")
    posted = hot_join(posted, sizes, "post", "n", len(TRIPLES) * fps.count()).withColumn("blocks", F.ceil(F.col("n") / split).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(mine, o) * F.col("blocks") + F.greatest(mine, o))
    dealt = posted.select("post", F.explode(pair).alias("pair"), "fp", "id")
    # pairs of blocks are dealt apart; rows of one come together and sorted
    return dealt.repartition("post", "pair").sortWithinPartitions("post", "pair", "fp").mapInArrow(_walked, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every id in `edges` (a, b) with the smallest id it reaches, by large-star and small-star joins.

    Rounds go on until all that is left are stars: every id has one link down, and to an id that has none. An id with
    very many links is sent to where these are (`hot_join`).
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        tally = edges.groupBy("u").agg(F.count("*").alias("n")).agg(F.sum("n").alias("links"), F.max("n").alias("most")).first()
        if (tally["most"] or 0) <= 1 and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        links = 2 * tally["links"]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both, least, "u", "n", links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, low, "u", "n", links).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(small)
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp, component): each row's fingerprint and the smallest key that it reaches over links, itself included."""
    fps = cut(fingerprints(docs, text, key, shingle, seed))
    distinct = cut(fps.groupBy("fp").agg(F.min("key").alias("id"), F.count("*").alias("n")))
    roots = components(links(distinct.where("id is not null").select("fp", "id")))
    named = distinct.join(roots, "id", "left").select("fp", "n", F.coalesce("root", "id").alias("component"))
    return hot_join(fps, named, "fp", "n", fps.count()).select("key", "fp", "component")


#: Similarity |A and B| / |A or B| of two texts' distinct five-word shingles from which on they are linked: 4 / 5.
SIM = (4, 5)
#: Words of a shingle of the overlap.
SHINGLE = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles; a text of fewer words is one shingle, a blank one has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    x = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        x = (x + h[k : k + n]) * _MIX
    return np.unique(x ^ (x >> np.uint64(32)))


def prefix(n: int) -> int:
    """Of n shingles in an order that all texts share, how many come first such that any two similar texts have one of these in common."""
    return n - -(-SIM[0] * n // SIM[1]) + 1 if n else 0


def _posts(rows: DataFrame, late: np.ndarray) -> DataFrame:
    """Rows (key, text) to (post, id, size), a row for each shingle of the prefix; those in `late` come last, in the order of `late`."""
    place = np.argsort(late)
    known = late[place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            posts, sizes, counts = [], [], []
            for x in b.column(1):
                h = shingles(x.as_py())
                n = len(h)
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    is_late = known[at] == h
                    h = np.concatenate([h[~is_late], h[is_late][np.argsort(place[at[is_late]])]])
                posts.append(h[: prefix(n)])
                sizes.append(n)
                counts.append(len(posts[-1]))
            got = np.concatenate(posts).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(np.repeat(b.column(0).to_numpy(), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts))], ["post", "id", "size"])

    return rows.mapInArrow(run, "post long, id long, size int")


def _late(rows: DataFrame, one_in: int = 8, least: int = 4, most: int = 50_000) -> np.ndarray:
    """Frequent shingles by a sample of texts, the rarest first. Any order of shingles is right; with these last, few unlike texts meet.

    All shingles of a text count: what others of its prefix go behind, it's the next ones that come into the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 32):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(x.as_py()) for x in b.column(0)]).view(np.int64))], ["post"])

    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0).select("text")
    seen = sample.mapInArrow(run, "post long").groupBy("post").count().where(F.col("count") >= least)
    return seen.orderBy(F.desc("count"), "post").limit(most).toArrow().column("post").to_numpy()[::-1].astype(np.int64).view(np.uint64)


#: Cells that a text's shingles are counted in by hash; texts can't share more in a cell than the smaller count. FINE: for pairs that are left.
CELLS, FINE = 128, 1024


def _cells(h: np.ndarray, cells: int) -> bytes:
    """The counts, cut at 255: texts with such a count aren't judged by them."""
    return np.minimum(np.bincount((h >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def _counted(rows: DataFrame, cells: int) -> DataFrame:
    """Rows (key, text) to (id, size, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [shingles(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in got], pa.int32()), pa.array([_cells(h, cells) for h in got], pa.binary())], ["id", "size", "cells"])

    return rows.mapInArrow(run, "id long, size int, cells binary")


#: Bits of the map by which texts are chosen where they lie, so that they needn't be shuffled.
SLOTS = 1 << 24


def _slot(key: str):
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(SLOTS))


def _marked(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `rows` (key, text) that `ids` (key) name, and a few others of the same bit; what others bring is true as well, only not asked for."""
    bits = ids.groupBy(F.bitmap_bucket_number(_slot("key")).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_slot("key"))).alias("bits"))
    at = rows.select("key", "text", F.bitmap_bucket_number(_slot("key")).alias("n"), F.bitmap_bit_position(_slot("key")).alias("i"))
    bit = F.expr("shiftright(cast(conv(hex(substring(bits, cast(i div 8 as int) + 1, 1)), 16, 10) as int), cast(i % 8 as int)) & 1")
    return at.join(F.broadcast(cut(bits)), "n").where(bit == 1).select("key", "text")


def _asked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The `rows` that `pairs` name, and a few others."""
    return _marked(pairs.select(F.explode(F.array("a", "b")).alias("key")), rows)


def _allowed(pairs: DataFrame, rows: DataFrame, cells: int) -> DataFrame:
    """Those of `pairs` (a, b) that may be similar by the counts of so many cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices([batch], 1024):
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, cells) for i in (3, 5))
                most = np.minimum(x, y).sum(1, dtype=np.int64)
                sizes = b.column(2).to_numpy().astype(np.int64) + b.column(4).to_numpy()
                may = ((SIM[0] + SIM[1]) * most >= SIM[0] * sizes) | (x == 255).any(1) | (y == 255).any(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(may))

    counts = cut(_counted(_asked(pairs, rows), cells))
    both = pairs.join(counts.select(F.col("id").alias("a"), F.col("size").alias("n"), F.col("cells").alias("x")), "a").join(counts.select(F.col("id").alias("b"), F.col("size").alias("m"), F.col("cells").alias("y")), "b")
    return cut(both.select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long").distinct())


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose texts in `rows` (key, text) have a true similarity of SIM or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x.as_py()).view(np.int64) for x in b.column(1)], pa.list_(pa.int64()))], ["key", "h"])

    pairs = _allowed(pairs, rows, FINE)
    sets = cut(_asked(pairs, rows).mapInArrow(run, "key long, h array<long>"))
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("h").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where((SIM[0] + SIM[1]) * shared >= SIM[0] * (F.size("x") + F.size("y"))).select("a", "b").distinct()


def _candidates(batches: Iterator[pa.RecordBatch], most_held: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows (post, pair, id, size, root, cells), each posting's together, to pairs (a, b) of different roots that may be similar.

    Near copies meet in many postings: a pair is returned once for as long as it is among the `most_held` that are remembered.
    """
    held: list[tuple] = []
    last = None
    told: set[tuple[int, int]] = set()

    def out():
        ids, sizes, roots = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[:3])
        cells = np.frombuffer(b"".join(x[3] for x in held), np.uint8).reshape(-1, CELLS)
        full = (cells == 255).any(1)
        a, b = [], []
        for i in range(len(ids) - 1):
            n, m = sizes[i], sizes[i + 1 :]
            js = np.flatnonzero((roots[i + 1 :] != roots[i]) & (ids[i + 1 :] != ids[i]) & (SIM[1] * np.minimum(n, m) >= SIM[0] * np.maximum(n, m))) + i + 1
            most = np.minimum(cells[js], cells[i]).sum(1, dtype=np.int64)
            js = js[((SIM[0] + SIM[1]) * most >= SIM[0] * (n + sizes[js])) | full[i] | full[js]]
            a.append(np.minimum(ids[js], ids[i]))
            b.append(np.maximum(ids[js], ids[i]))
        new = [x for x in dict.fromkeys(zip(np.concatenate(a).tolist(), np.concatenate(b).tolist(), strict=True)) if x not in told]
        if len(told) + len(new) > most_held:
            told.clear()
        told.update(new[:most_held])
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in new], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for b in slices([batch], 1024):
            for post, pair, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (post, pair) != last:
                    if len(held) > 1:
                        yield out()
                    held, last = [], (post, pair)
                held.append(tuple(row))
    if len(held) > 1:
        yield out()


def _sums(posted: DataFrame) -> DataFrame:
    """(post, first, first_size, n): of the postings (post, id, size) with two texts or more one for each set of rows, with its smallest id and its number of rows.

    Sets are told apart by two sums of 36-bit hashes, the number of rows and the first and last id. Postings are summed
    up where they are before they meet.
    """
    held = [F.sum(F.shiftrightunsigned(F.xxhash64(*c), 28)).alias(name) for name, c in (("x", ("id", "size")), ("y", ("size", "id")))]
    sums = posted.groupBy("post").agg(F.min("id").alias("first"), F.min_by("size", "id").alias("first_size"), F.max("id").alias("last"), F.count("*").alias("n"), *held)
    return sums.where("first < last").groupBy("first", "last", "n", "x", "y").agg(F.min("post").alias("post"), F.min("first_size").alias("first_size")).select("post", "first", "first_size", "n")


def overlap_links(rows: DataFrame, split: int = 1000) -> DataFrame:
    """(a, b): keys of `rows` (key, text), enough of them to join all pairs of similarity SIM or more, and none below it.

    Any such pair has a shingle of both prefixes in common. Near copies share many, so of postings that hold the same
    texts one stays (`_sums`). In each the texts are first compared with its smallest key, which joins large groups
    of near copies; then all pairs that this left in different components, if the counts of their cells allow it. Postings above `split` texts are dealt over pairs of blocks.
    """
    alike = lambda a, b: SIM[1] * F.least(a, b) >= SIM[0] * F.greatest(a, b)
    posted = cut(_posts(rows, _late(rows)))
    sums = cut(_sums(posted))
    met = cut(hot_join(posted, sums, "post", "n", posted.count()).select("post", "id", "size", "first", "first_size"))
    star = cut(met.where("id > first").where(alike(F.col("size"), F.col("first_size"))).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    found = cut(_verified(_allowed(star, rows, CELLS), rows))
    roots = components(found)
    named = cut(met.select("post", "id", "size").join(roots, "id", "left").select("post", "id", "size", F.coalesce("root", "id").alias("root")))
    apart = cut(named.groupBy("post").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("post", "n"))
    mixed = hot_join(named, apart, "post", "n", named.count()).withColumn("blocks", F.ceil(F.col("n") / split).cast("int"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(mine, o) * F.col("blocks") + F.greatest(mine, o))
    mixed = cut(mixed.select("post", F.explode(pair).alias("pair"), "id", "size", "root"))
    cells = _counted(_marked(mixed.select(F.col("id").alias("key")), rows), CELLS).select("id", "cells")
    dealt = mixed.join(cells, "id").select("post", "pair", "id", "size", "root", "cells").repartition("post", "pair").sortWithinPartitions("post", "pair")
    rest = dealt.mapInArrow(_candidates, "a long, b long").distinct()
    rest = cut(rest.join(star, ["a", "b"], "left_anti"))
    return found.unionByName(_verified(rest, rows))


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, component): components over both kinds of links, those of `near_duplicates` and those of `overlap_links`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in slices(batches):
            texts = b.column(1).to_pylist()
            narrow = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            words = [xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(narrow), pa.array(words, pa.binary())], ["key", "fp", "words"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).where("key is not null")
    got = cut(rows.mapInArrow(run, "key long, fp long, words binary"))
    # a row for the same words: copies are one from here on
    nodes = cut(got.groupBy("fp", "words").agg(F.min("key").alias("id"), F.count("*").alias("n")))
    own = got.select("key", F.xxhash64("fp", "words").alias("node"))
    narrow = nodes.groupBy("fp").agg(F.min("id").alias("id"))
    same = nodes.join(narrow.select("fp", F.col("id").alias("b")), "fp").select(F.col("id").alias("a"), "b")
    once = _marked(nodes.select(F.col("id").alias("key")), rows)
    roots = components(links(narrow).unionByName(overlap_links(once)).unionByName(same))
    named = nodes.join(roots, "id", "left").select(F.xxhash64("fp", "words").alias("node"), "n", F.coalesce("root", "id").alias("component"))
    return hot_join(own, named, "node", "n", got.count()).select("key", "component")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that name their component (by `near_copies`), one a component; rows of a null key stay. Of repeated rows one stays."""
    found = cut(near_copies(docs, text, key))
    kept = found.where("key = component").select(F.col("key").alias("_kept")).distinct()
    rows = docs.where(F.col(f"`{key}`").isNotNull()).join(kept, F.col(f"`{key}`") == F.col("_kept"), "left_semi")
    again = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_again"))
    once = rows.join(again, F.col(f"`{key}`") == F.col("_again"), "left_anti")
    one = rows.join(again, F.col(f"`{key}`") == F.col("_again"), "left_semi").dropDuplicates([key])
    return once.unionByName(one).unionByName(docs.where(F.col(f"`{key}`").isNull()))

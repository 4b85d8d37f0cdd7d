"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Kinds of spans, in order: assign, access, hex (patterns) and random (the models). A random span is what the patterns'
spans leave of a run of `[A-Za-z0-9+/_=-]`, if that is at least `least` characters and its characters are more
likely under the model of random strings than under that of ordinary identifiers, by `per_char` a character
and `total` in all (natural logarithms). Spans count code points, ends are exclusive.

The models learn from labelled strings: those of `sample`, made by rule, and those of `labelled`, which come from the
documents: values that a pattern found are secrets, other runs are ordinary.

A null text is empty and has no spans; repeated rows are scanned apart; texts are scanned whole, whatever
their length; other columns stay in `redact` and play no part in `scan`, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: One of these is in each match of ASSIGN, in lower case.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

#: Words that the built-in sample of ordinary identifiers is made of.
WORDS = """account action active address after amount array author average back base batch before begin block body bound buffer build
button cache call change channel char check child class clean clear click client clock close code color column command common compare
complete config connect const content context control copy count create current cursor data date default delete depth detail device
direct disable document domain double download driver edge element empty enable encode engine entry error event example execute export
factory field file filter final find first flag float folder font format forward frame function global graph group handler hash head
header height history index inner input insert instance integer interface internal item iterator join label language last layer layout
length level library limit line link list load local location lock loop main manager mapping match matrix maximum member memory merge
message method minimum mode model module mouse move name network next node number object offset open option order output owner package
page panel parameter parent parse partition path pattern payload percent pixel point pointer policy position prefix previous print
process product profile project property protocol provider public query queue random range reader record reference register release
remove render report request reset resource response result return right root route rule sample scale schema scope screen script search
section select sequence server service session setting shape shared shift signal simple single size source space stack start state
static status step storage store stream string style submit suffix support symbol system table target task template temp test text
thread time title total trace track transform tree type union unique unit update upload user utility valid value variable vector version
view visible visit wait width window wrapper write the and that with from have this were which their would there about other these
information international responsibility government development administration characteristics understanding""".split()


@dataclass(frozen=True)
class Ratio:
    """table[a, b]: the logarithm of the two models' ratio for b after a; the last row is a run's start."""

    table: np.ndarray
    least: int = 20
    per_char: float = 0.6
    total: float = 14.0


def sample(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """A bounded labelled sample, made by rule: (text, 1) random strings of common alphabets, (text, 0) identifiers and rulers of one character."""
    rng, out = random.Random(seed), [(c * 400, 0) for c in ALPHABET]
    sets = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "-_", ALPHABET[26:62], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef")
    for i in range(n):
        out.append(("".join(rng.choice(sets[i % 6]) for _ in range(rng.randint(20, 64))), 1))
        w = [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
        out.append(((lambda x: (x[0] + "".join(map(str.title, x[1:])), "".join(map(str.title, x)), "_".join(x), "-".join(x), "/".join(x), "_".join(x).upper(), "".join(x), "-".join(x) + f"-{rng.randint(0, 2030)}")[i % 8])(w), 0))
    return out


def strings(text: str, least: int = 8) -> Iterator[tuple[str, int]]:
    """Labelled strings of a text: (value, 1) of each pattern's span, (run, 0) of each other run of ALPHABET."""
    found = patterns(text)
    for a, k, b in found:
        yield (ASSIGN.match(text, a).group(1) if k == 0 else text[a:b]), 1
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{least},}}", text):
        if not any(s < m.end() and m.start() < e for s, _, e in found):
            yield m.group(), 0


def labelled(docs: DataFrame, most: int = 4000, rows: int = 20_000, seed: int = 3, text: str = "text", key: str = "doc_id") -> list[tuple[str, int]]:
    """A bounded sample of labelled strings: at most `most` distinct ones of each label, from about `rows` documents.

    Documents are chosen by a hash of id and text, then strings by a hash of their own, so equal tables give equal
    samples. A string that a pattern found anywhere counts as a secret.
    """
    total = docs.count()
    mark = F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))
    chosen = docs.where(F.pmod(mark, F.lit(1 << 40)) < F.lit(min(1 << 40, (rows << 40) // max(total, 1)))).select(F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = dict(sorted(x for t in b.column(0) for x in strings(t.as_py() or "")))
            yield pa.RecordBatch.from_arrays([pa.array(got.keys(), pa.string()), pa.array(got.values(), pa.int32())], ["string", "label"])

    found = cut(chosen.mapInArrow(run, "string string, label int").groupBy("string").agg(F.max("label").alias("label")))
    out = []
    for label in (0, 1):
        out += [(r["string"], label) for r in found.where(F.col("label") == label).orderBy(F.xxhash64(F.lit(seed), "string"), "string").limit(most).collect()]
    return out


def judged(found: list[tuple[str, int]], ratio: Ratio) -> tuple[float, float]:
    """Precision and recall of the models over labelled strings of at least `least` characters; 1 where there is nothing to find."""
    held = [x for x in found if len(x[0]) >= ratio.least]
    s, n, y = scores([t for t, _ in held], ratio), np.array([len(t) for t, _ in held]), np.array([k for _, k in held], bool)
    hit = (s >= ratio.total) & (s >= ratio.per_char * n)
    return float((hit & y).sum() / max(hit.sum(), 1)) if hit.any() else 1.0, float((hit & y).sum() / y.sum()) if y.any() else 1.0


def train(labelled: list[tuple[str, int]], add: float = 0.3, **limits) -> Ratio:
    """Both models' first-order chains from (text, 1 for random or 0) rows, with `add` for unseen steps."""
    k = len(ALPHABET)
    counts = np.full((2, k + 1, k), add)
    for text, kind in labelled:
        codes = CODE[np.frombuffer(re.sub(rf"[^{re.escape(ALPHABET)}]", "", text).encode(), np.uint8)]
        if len(codes):
            np.add.at(counts[kind], (np.r_[k, codes[:-1]], codes), 1)
    logs = np.log(counts / counts.sum(2, keepdims=True))
    return Ratio(logs[1] - logs[0], **limits)


def scores(runs: list[str], ratio: Ratio) -> np.ndarray:
    """The log-likelihood ratio of each run, all at once."""
    if not runs:
        return np.zeros(0)
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    codes = CODE[np.frombuffer("".join(runs).encode(), np.uint8)]
    start = np.r_[0, np.cumsum(size)[:-1]]
    before = np.r_[0, codes[:-1]]
    before[start] = len(ALPHABET)
    return np.add.reduceat(ratio.table[before, codes], start)


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans; kind is a place in KINDS."""
    low = text.lower()
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8] if any(x in low for x in HINTS) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def spans(texts: list[str], ratio: Ratio) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, by start and then kind."""
    out, runs, where = [], [], []
    for i, text in enumerate(texts):
        found = patterns(text)
        for m in LONG.finditer(text):
            a, end = m.span()
            # what the patterns' spans leave of the run, in pieces
            for s, e in [*sorted((s, e) for s, _, e in found if s < end and a < e), (end, end)]:
                if s - a >= ratio.least:
                    runs.append(text[a:s])
                    where.append((i, a, s))
                a = max(a, e)
        out.append(found)
    for (i, a, b), s in zip(where, scores(runs, ratio), strict=True):
        if s >= ratio.total and s >= ratio.per_char * (b - a):
            out[i].append((a, 3, b))
    return [sorted(x) for x in out]


def named(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, ratio: Ratio | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_random, base_sha256, spans): every row of `docs`."""
    ratio = ratio or train(sample())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = spans([x or "" for x in b.column(1).to_pylist()], ratio)
            counts = [pa.array([sum(k == x for _, k, _ in f) for f in found], pa.int64()) for x in range(4)]
            base = [hashlib.sha256(named([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(base, pa.string()), pa.array(map(named, found), pa.string())], ["key", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
    return got.withColumnRenamed("key", key)


def redact(docs: DataFrame, ratio: Ratio | None = None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each secret's characters replaced by `mark`; of an assignment only the value goes."""
    ratio = ratio or train(sample())
    at = docs.columns.index(text)

    def hide(x: str, found: list[tuple[int, int, int]]) -> str:
        out, end = [], 0
        cuts = sorted((ASSIGN.match(x, a).start(1) if k == 0 else a, b) for a, k, b in found)
        for a, b in cuts:
            if a >= end:
                out += [x[end:a], mark]
            end = max(end, b)
        return "".join([*out, x[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            found = spans([x or "" for x in texts], ratio)
            new = pa.array([hide(x, f) if f else x for x, f in zip(texts, found, strict=True)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)

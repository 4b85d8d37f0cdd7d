import numpy as np
import pytest
import sentencepiece

from tessera.llm import pieces

ODD = ["", " ", "  a  b ", "Hello  world\n\té x 😀", "\n\n  \n x", "ａ①\x00", "a" * 300, " " * 50 + "x", " \n " * 9]


@pytest.fixture(scope="module")
def vocab():
    return pieces.load()


def test_without_dropout_equals_the_library(vocab, docs):
    p = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ODD + [r["text"] for r in docs.collect()]
    got = pieces.Encoder(vocab, pieces.Dropout(rate=0)).encode_all(texts, [0] * len(texts))
    assert [g.tolist() for g in got] == [p.encode(t) for t in texts]


def test_agendas_together_equal_one_by_one(vocab, docs):
    e = pieces.Encoder(vocab)
    units = sorted({u for r in docs.limit(60).collect() for u in e.unit.findall(" " + r["text"])} | {" ▁x", "a" * 60})
    for mask in (0, 1, 6, 0b10101):
        got = e.many(units, np.full(len(units), mask, np.uint64), np.zeros(len(units), np.int64))[0]
        assert got == [e.one(u, pieces.masked(mask)) for u in units]


def finalised(x):
    m = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def plain(vocab, units, key, rate, seed):
    """Merge-dropout as its description has it, one pair at a time, with nothing kept."""
    m, gold = (1 << 64) - 1, 0x9E3779B97F4A7C15
    ids = {p: i for i, (p, _, byte) in enumerate(vocab) if p and not byte}
    order = {p: r for r, p in enumerate(sorted((p for p in ids if len(p) > 1), key=lambda p: (-vocab[ids[p]][1], ids[p])))}
    byte = {int(p[3:5], 16): i for i, (p, _, is_byte) in enumerate(vocab) if is_byte}
    out, base = [], finalised((seed * gold ^ finalised(key & m)) & m)
    for place, unit in enumerate(units):
        draw = finalised((place * gold + base) & m) | 1
        parts, skipped = [(i, "\ue000" if c == "▁" else "▁" if c == " " else c) for i, c in enumerate(unit)], set()
        while True:
            open_ = [(order[a + b], i, n) for n, ((i, a), (_, b)) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in order and (i, a + b) not in skipped]
            if not open_:
                break
            rank, i, n = min(open_)
            piece = parts[n][1] + parts[n + 1][1]
            if ((i << 40 | len(piece) << 20 | rank) * draw + (draw >> 1) & m) < int(rate * 2**64):
                skipped.add((i, piece))
            else:
                parts[n : n + 2] = [(i, piece)]
        for _, a in parts:
            out += [ids[a]] if a in ids else [byte[x] for x in a.replace("▁", " ").replace("\ue000", "▁").encode()]
    return out


@pytest.mark.parametrize(("rate", "seed"), [(0.1, 1), (0.5, 9), (0.9, 2)])
def test_dropout_equals_a_plain_version(vocab, docs, rate, seed):
    e = pieces.Encoder(vocab, pieces.Dropout(rate=rate, seed=seed))
    texts = [*ODD[:-2], "a▁b ▁", " antidisestablishmentarianism " * 5, "x" * 70, *(r["text"][:600] for r in docs.limit(12).collect())]
    for again in range(2):  # with nodes made and kept
        for key, (t, got) in enumerate(zip(texts, e.encode_all(texts, list(range(len(texts))), piece=1 << 18 if again else 50), strict=True)):
            assert got.tolist() == plain(vocab, e.unit.findall(" " + t) if t else [], key, rate, seed)


def test_round_trip_varied_and_repeatable(vocab, docs):
    e, again = pieces.Encoder(vocab), pieces.Encoder(vocab, pieces.Dropout(cached=100, nodes=300))
    texts = [*ODD, "▁ ▁a", "a▁b", *(r["text"] for r in docs.limit(80).collect())]
    keys = list(range(len(texts)))
    ids = e.encode_all(texts, keys)
    assert [e.decode(i.tolist()) for i in ids] == texts
    assert [i.tolist() for i in ids] == [again.encode(t, k).tolist() for t, k in zip(texts, keys, strict=True)]
    other = e.encode_all(texts, [k + 1000 for k in keys])
    assert any(len(a) != len(b) for a, b in zip(ids, other, strict=True))
    whole = pieces.Encoder(vocab, pieces.Dropout(rate=1.0)).encode("the same words", 1)
    assert len(whole) == len(" the same words")


def test_every_occurrence_draws(vocab):
    """One word many times over: pairs stay apart in about the rate's share, and rare segmentations appear."""
    n = 20_000
    e = pieces.Encoder(vocab, pieces.Dropout(rate=0.3))
    plain_ids = pieces.Encoder(vocab, pieces.Dropout(rate=0)).encode("be")
    assert len(plain_ids) == 1
    ids = e.encode(" ".join(["be"] * n), 5)
    apart = n - int((ids == plain_ids[0]).sum())
    # " be" is whole unless one of its two merges is skipped, or an other pair is taken then
    assert 0.25 < apart / n < 0.55
    long = pieces.Encoder(vocab, pieces.Dropout(rate=0.1))
    forms = {long.encode_all(["segmentation"], [k])[0].tobytes() for k in range(3000)}
    assert len(forms) > 40


def test_encoders_are_kept_by_the_whole_vocabulary(vocab):
    a, b = len(vocab) // 2, len(vocab) // 2 + 1
    other = list(vocab)
    other[a], other[b] = vocab[b], vocab[a]
    assert pieces.digest(other) != pieces.digest(vocab)
    one = pieces._encoder(vocab, pieces.digest(vocab), pieces.Dropout())
    assert pieces._encoder(vocab, pieces.digest(vocab), pieces.Dropout()) is one
    assert pieces._encoder(other, pieces.digest(other), pieces.Dropout()) is not one


def test_odd_rows(odd):
    got = pieces.encoded(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and all(r["lossless"] for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    texts = sorted(r["text"] or "" for r in odd.collect())
    assert sorted(r["text"] for r in pieces.decoded(got).collect()) == texts

import gzip
import hashlib
import zlib
from base64 import b32encode
from collections import Counter

import pytest

from tessera.llm import warc
from tessera.llm.common import fresh_dir

PAGES = [(1, "http://a", "<p>é</p>"), (5, "http://b\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (6, "http://c", "z" * 300_000), (None, "n", "z" * 300_000), (7, "q", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (8, "r", "x"), (8, "r", "x")]


def archive(spark, df, least=0):
    mono, out = fresh_dir(spark, "mono"), fresh_dir(spark, "warc")
    warc.write_monolithic(df, mono, least)
    warc.normalise(spark, mono, out)
    return mono, out


def brute(pages):
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        b, t = (h or "").encode(), top.get(h or "")
        again = t is not None and (i is None or i < t)
        out.append((i, len(b), b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", t if again else None))
    return Counter(out)


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    _, out = archive(spark, df)
    got = warc.read(spark, out).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == brute(PAGES)
    html = {(p[0], p[2] or "") for p in PAGES}
    assert all((r["page_id"], r["html"]) in html for r in got if r["record_type"] == "response")


def test_documents_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    _, out = archive(spark, df)
    got = warc.read(spark, out)
    assert Counter(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == brute([tuple(r) for r in df.select("page_id", "url", "html").collect()])


def test_many_revisits_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 0)
    test_round_trip(spark)


def test_least_size(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    _, out = archive(spark, df, least=3)
    assert {r["page_id"]: r["record_type"] for r in warc.read(spark, out).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_each_member_stands_alone(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * i) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    mono, out = archive(spark, df)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out).collect()
    index = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(out).collect()
    assert len(files) == len(index) == 1
    data, lines = bytes(files[0]["content"]), bytes(index[0]["content"]).decode().splitlines()
    assert len(lines) == 40 and sum(int(x.split()[1]) for x in lines) == len(data)
    for line in lines:
        at, n, name, _ = line.split()
        one = gzip.decompress(data[int(at) : int(at) + int(n)])
        assert one.startswith(b"WARC/1.1\r\n") and name.encode() in one
    whole = b"".join(gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").load(mono).where("length > 0").collect() if r["path"].endswith(".gz"))
    assert whole == gzip.decompress(data)


def test_broken_archives_are_errors():
    with pytest.raises(ValueError, match="early"):
        list(warc.records(gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nabc")))
    with pytest.raises(ValueError, match="no record"):
        list(warc.records(gzip.compress(b"junk\r\n")))
    with pytest.raises(ValueError, match="header"):
        list(warc.records(gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n")))


def test_a_cut_archive_is_an_error_wherever_it_is_cut():
    one = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    for data, whole in ((gzip.compress(one * 50), {0}), (gzip.compress(one) * 3, {0, len(gzip.compress(one)), 2 * len(gzip.compress(one))})):
        assert len(list(warc.records(data))) in (3, 50)
        for n in range(len(data)):
            if n in whole:  # the end of a member is an end
                list(warc.records(data[:n]))
            else:
                with pytest.raises((ValueError, zlib.error)):
                    list(warc.records(data[:n]))


def test_output_is_held_a_step_at_a_time():
    one = b"WARC/1.1\r\nContent-Length: 30000000\r\n\r\n" + bytes(30_000_000) + b"\r\n\r\n"
    flow = warc.Stream(gzip.compress(one) + bytes(100) + gzip.compress(one), step=1 << 16)
    most = n = 0
    for _, _, size in warc.heads(flow):
        for piece in flow.pieces(size):
            n += len(piece)
            most = max(most, len(flow.buffer) + len(piece))
    assert n == 60_000_000 and most <= 2 << 16


def test_equal_pages_without_any_id_keep_their_payloads(spark):
    df = spark.createDataFrame([(None, "a", "same"), (None, "b", "same"), (None, "c", "x"), (2, "d", "x")], "page_id long, url string, html string")
    _, out = archive(spark, df)
    got = sorted((r["url"], r["record_type"], r["refers_to"], r["html"]) for r in warc.read(spark, out).collect())
    assert got == [("a", "response", None, "same"), ("b", "response", None, "same"), ("c", "revisit", 2, None), ("d", "response", None, "x")]


def test_long_archives_are_read_in_stretches_and_stores_without_streams_whole(spark, monkeypatch):
    df = spark.createDataFrame([(i, "u", f"page {i} " * i) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "_reached", lambda folder: False)
    _, out = archive(spark, df)
    got = warc.read(spark, out, per_task=500)
    assert got.rdd.getNumPartitions() > 4
    assert {r["page_id"]: r["html"] for r in got.collect()} == {i: f"page {i} " * i for i in range(40)}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    _, out = archive(spark, df)
    assert warc.read(spark, out).count() == 0

"""WARC archives: written as one gzip stream a file, normalised to a member a record with an offset index, read back.

Of records with equal payloads (of at least `least` bytes) that with the largest page id is the response and
the others are revisits of it, which hold its HTTP header and no payload. A page's record is named by its
id, so a revisit's reference gives the page it refers to.

Odd rows: a null html is an empty payload; a null url is written as `urn:page:none`; control characters in a
url are percent-encoded, so they can't end a header. A null page id is the smallest; rows of equal payloads that
all lack an id are all responses. Rows of equal page id and payload are records of their own and of one type. An
empty table gives archives without records. Very long payloads are one Spark value on the way in and out (below 2 GB);
the normaliser passes them on in pieces. Columns other than page_id, url and html play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, hot_join

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits that are sent to all executors at most, about 10 MB; more are joined by shuffles.
SMALL = 100_000


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of a value's SHA-1, as a column expression."""
    hexed, out = F.sha1(data), []
    for k in range(8):
        five = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(five, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(rid, rdigest, refers_to): the rows of (rid, rdigest, size) that revisit another; a row each.

    A group without any id has no record that others could name, so its rows stay responses.
    """
    found = cut(pages.where(F.col("size") >= least).select("rid", "rdigest"))
    groups = found.groupBy("rdigest").agg(F.max("rid").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    again = hot_join(found, groups, "rdigest", "n", found.count()).where("rid is null or rid < refers_to")
    return again.select("rid", "rdigest", "refers_to").distinct()


def write_monolithic(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> str:
    """Writes `pages` (page_id, url, html) below `path`, each file one gzip stream of records; gives `path`."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), sha1_base32(html).alias("digest"))
    # the payloads stay where they are unless there are many revisits
    again = cut(revisits(rows.select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "size"), least))
    again = F.broadcast(again) if again.count() <= SMALL else again
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    is_again = F.col("rdigest").isNotNull()
    crlf = F.lit("\r\n")
    url = F.coalesce(F.replace(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\0"), F.lit("%00")), F.lit("urn:page:none"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), crlf, crlf)
    body = F.concat(http, F.when(is_again, F.lit("")).otherwise(F.col("html")))
    kind = F.when(is_again, F.concat(F.lit("revisit\r\nWARC-Profile: "), F.lit(PROFILE), F.lit("\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(F.lit("response"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(F.col("id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), crlf, crlf, body, crlf,
    )
    # the sink's line separator is the record's last line end
    rows.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n").text(path)
    return path


class Stream:
    """What gzip data of one member or many inflates to, read and held a step at a time; `source` is bytes or has read(n)."""

    def __init__(self, source, step: int = 1 << 20) -> None:
        self.source, self.step = source if hasattr(source, "read") else io.BytesIO(source), step
        self.flow, self.raw, self.buffer = None, b"", bytearray()

    def more(self) -> bool:
        """Adds what up to `step` bytes inflate to, no more than `step`; False at the data's end, which has to be a member's."""
        while True:
            if self.flow is not None and self.flow.eof:
                self.raw, self.flow = self.flow.unused_data, None
            if self.flow is None:
                self.raw = self.raw.lstrip(b"\0")  # padding between members
            # what was read may be used up and output still be due
            got = self.flow.decompress(self.raw, self.step) if self.flow is not None else b""
            if self.flow is not None and not self.flow.eof:
                self.raw = self.flow.unconsumed_tail
            if got:
                self.buffer += got
                return True
            if self.flow is not None and (self.flow.eof or self.raw):
                continue
            if not self.raw:
                self.raw = bytes(self.source.read(self.step))
                if not self.raw:
                    if self.flow is not None:
                        raise ValueError("the archive ends within a member")
                    return False
            if self.flow is None and self.raw.lstrip(b"\0"):
                self.flow = zlib.decompressobj(31)
                self.raw = self.raw.lstrip(b"\0")

    def line(self) -> bytes | None:
        """Up to and with the next line feed; None at the end."""
        seen = 0
        while (k := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self.more():
                return self._off(len(self.buffer)) if self.buffer else None
        return self._off(k + 1)

    def _off(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError(f"the archive ends {n} bytes early")
            got = self._off(min(n, len(self.buffer)))
            n -= len(got)
            yield got

    def take(self, n: int) -> bytes:
        return b"".join(self.pieces(n))


def heads(flow: Stream) -> Iterator[tuple[bytes, dict[str, str], int]]:
    """(header as it stands, its fields by lower-case name, bytes of its block) of each record; the block is to be read before the next."""
    while (line := flow.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head, fields = [line], {}
        while (line := flow.line()) is not None and line.strip():
            head.append(line)
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        if line is None or not fields.get("content-length", "").isdigit():
            raise ValueError(f"a record's header is cut or has no length: {head[0][:40]!r}")
        yield b"".join(head), fields, int(fields["content-length"])


def records(source) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(header as it stands, its fields by lower-case name, block) of each record of gzip data."""
    flow = Stream(source)
    for head, fields, size in heads(flow):
        yield head, fields, flow.take(size)


def _named(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _store(folder: str):
    """The file system of a folder that driver and executors share, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _whole(store, path: str, *names: str):
    """Output streams of files that are moved to their names below `path` when all are whole, so that a task that ran twice leaves one of each."""
    mark = uuid.uuid4().hex
    parts = [posixpath.join(path, f"_{n}.{mark}") for n in names]
    outs = [store.open_output_stream(p, compression=None) for p in parts]

    def done() -> None:
        for out, part, name in zip(outs, parts, names, strict=True):
            out.close()
            store.move(part, posixpath.join(path, name))

    return outs, done


def _reached(folder: str) -> bool:
    """Whether files of the folder can be opened as streams here and so by workers; else Spark's reader brings them whole."""
    try:
        store, path = _store(folder)
        return store.get_file_info(path).type.name != "NotFound"
    except (ValueError, OSError, pa.ArrowException):
        return False


def normalise(spark: SparkSession, source: str, target: str, level: int = 4) -> None:
    """Rewrites each archive in the folder `source`, of any gzip layout, to `target`, a member a record, with its index.

    The index `<archive>.idx` has a line a record: offset, length of the member, record id, type. A file is a
    stream that is inflated once, from start to end, and written as it goes, so that a worker holds a step of it and
    never a file or a record. Data that ends within a member or a record is an error. A source in a store that only
    Spark's readers open is read whole instead (files up to 2 GB).
    """
    stream = _reached(source)

    def rewrite(name: str, data) -> tuple[int, int]:
        store, path = _store(target)
        store.create_dir(path)
        (out, index), done = _whole(store, path, name, name + ".idx")
        n, at, flow = 0, 0, Stream(data)
        for head, fields, size in heads(flow):
            pack, start = zlib.compressobj(level, zlib.DEFLATED, 31), at
            for x in chain((head, b"\r\n"), flow.pieces(size), (b"\r\n\r\n",)):
                got = pack.compress(x)
                out.write(got)
                at += len(got)
            got = pack.flush()
            out.write(got)
            at += len(got)
            index.write(f"{start} {at - start} {fields.get('warc-record-id')} {fields.get('warc-type')}\n".encode())
            n += 1
        done()
        return n, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = posixpath.basename(path).removesuffix(".gz").removesuffix(".txt").removesuffix(".warc") + ".warc.gz"
                if stream:
                    store, folder = _store(source)
                    with store.open_input_stream(posixpath.join(folder, posixpath.basename(path)), compression=None) as f:
                        n, size = rewrite(name, f)
                else:
                    n, size = rewrite(name, data.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
    found = found.select("path", F.lit(None).cast("binary").alias("content") if stream else F.col("content"))
    if not found.mapInArrow(run, "archive string, records long, bytes long").agg(F.count("*")).first()[0]:
        store, path = _store(target)
        store.create_dir(path)
        _whole(store, path, "empty.warc.gz", "empty.warc.gz.idx")[1]()


def read(spark: SparkSession, path: str, payloads: bool = True, per_task: int = 64 << 20) -> DataFrame:
    """(archive, offset, length, page_id, record_type, refers_to, payload_bytes, payload_digest, url, html) of normalised archives.

    Members are found by the indexes, dealt to tasks of about `per_task` bytes, long archives in stretches, and each
    is read and inflated by itself. A response's digest is that of its payload, which has to agree with its header; a
    revisit has those of its header and a null html. Without `payloads` every html is null; they are read and
    checked all the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "offset", "length", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url", "html"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        store, folder = _store(path)
        rows, held, opened, file = [], 0, None, None
        for b in batches:
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != opened:
                    file, opened = store.open_input_file(posixpath.join(folder, archive)), archive
                file.seek(offset)
                _, fields, block = next(records(file.read(length)))
                http, _, payload = block.partition(b"\r\n\r\n")
                again = fields["warc-type"] == "revisit"
                size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if not again and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size):
                    raise ValueError(f"{archive} at {offset}: the payload isn't that of the header")
                html = payload.decode() if payloads and not again else None
                rows.append((archive, offset, length, _named(fields["warc-record-id"]), fields["warc-type"], _named(fields.get("warc-refers-to")) if again else None, size, digest, fields.get("warc-target-uri"), html))
                held += len(html or "")
                if len(rows) == 200 or held > 8 << 20:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    lines = spark.read.option("pathGlobFilter", "*.idx").text(path)
    entry = F.split("value", " ")
    members = lines.select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.idx$", "").alias("archive"), entry[0].cast("long").alias("offset"), entry[1].cast("long").alias("length"))
    tasks = -(-(members.agg(F.sum("length")).first()[0] or 0) // per_task)
    dealt = members.repartition(max(tasks, spark.sparkContext.defaultParallelism), "archive", F.floor(F.col("offset") / per_task)).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "archive string, offset long, length long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, html string")

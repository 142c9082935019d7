"""WARC archives: written by many tasks, read back from byte ranges.

A record is one gzip member. Writing: each task writes one archive into a folder that all machines see, under a name of
its own for each attempt; the table of written files holds those of tasks that succeeded, so files of lost attempts
are never read. Of equal payloads of 1000 bytes at least, that with the largest page id is a response and the others are
revisits of it; a revisit holds the HTTP headers only.

Reading: an archive is cut into byte ranges, and a task owns the records that start inside its range. It looks for the
gzip magic from the range's start and takes a place for a member only if the bytes there decode to a WARC header (magic
bytes occur inside compressed data, too): the version, a type, a record id and a length, which the unpacked member must
have. From an accepted member it goes on to the next where that one ends,
and reads past its range's end only to finish the last record it owns.

Cases: null payloads are empty; a null url is left out of the record and comes back null; rows that repeat are records
of their own (two rows with the largest id are both responses); a null page id is always a response; damaged bytes
between members, and members that are no such record, are skipped; a revisit without a digest or HTTP length has null
there; very long payloads are held by a task one at a time; other columns are not looked at; an empty table gives
archives without records or none, and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, fresh_path
from .text import batches

REVISIT_BYTES, RANGE_BYTES = 1000, 16 << 20
MAGIC, END = b"\x1f\x8b\x08", b"\r\n"
# Fixed values of the format.
VERSION, DATE = b"WARC/1.1", b"2000-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "content-length")
#: Bytes read at once, bytes read to look for a header, and the most that a header may have.
_CHUNK, _PROBE, _HEADER = 1 << 20, 1 << 14, 1 << 16


def _filesystem(path: str):
    """The file system of a Spark path and the path on it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [VERSION, b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: " + DATE]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    lines += [b"WARC-Payload-Digest: sha1:" + sha1, b"Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    lines.append(b"Content-Length: %d" % len(block))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(END.join(lines) + END + END + block + END + END) + packer.flush()


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(urn: str | None) -> int | None:
    tail = (urn or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def decode_header(data: bytes) -> dict[str, str] | None:
    """Fields of the record header at the start of data; None if there is none with all that a record needs."""
    if not data.startswith(VERSION[:5]) or END + END not in data[: _HEADER + 4]:
        return None
    fields = _headers(data[: data.index(END + END)])
    return fields if all(fields.get(c) for c in NEEDED) and fields["content-length"].isdecimal() else None


def decode_record(data: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of an unpacked record with a whole header."""
    fields = decode_header(data)
    start = data.index(END + END) + 4
    http, _, payload = data[start : start + int(fields["content-length"])].partition(END + END)
    kind = fields["warc-type"]
    if kind == "revisit":
        length, _, sha1 = _headers(http).get("content-length", ""), *fields.get("warc-payload-digest", "").partition(":")[1:]
        size, digest = int(length) if length.isdecimal() else None, _hex(sha1)
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, _page(fields.get("warc-refers-to"))


def _hex(sha1: str) -> str | None:
    """Hexadecimal form of a base-32 digest."""
    try:
        return base64.b32decode(sha1).hex() or None
    except ValueError:
        return None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row into folder; gives path, bytes and records of each archive."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    sums = rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")).filter(F.col("size") >= REVISIT_BYTES)
    again = sums.groupBy("digest", "size").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    revisits = sums.join(again, ["digest", "size"]).filter("page_id <> keep").select("page_id", "digest", "keep").distinct()
    marked = rows.withColumn("digest", F.sha1("html")).join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "keep")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, size, count, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches(it):
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            for page_id, url, html, keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = encode_record(page_id, url, html.encode(), keep)
                out.write(record)
                size, count = size + len(record), count + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([count])], names=["path", "bytes", "records"])

    return cut(marked.mapInArrow(write, "path string, bytes long, records long"), "archives")


def read_range(path: str, start: int, end: int) -> Iterator[bytes]:
    """The unpacked records that start at start or later and before end."""
    fs, where = _filesystem(path)
    with fs.open_input_file(where) as f:
        size, at = f.size(), start
        while at < min(end, size):
            member = _member(f, at, size)
            if member and is_record(member[0]):
                data, at = member
                yield data
                continue
            # look for the next magic, with an overlap of two bytes between chunks
            found, look = -1, at + 1
            while found < 0 and look < min(end, size):
                chunk = f.read_at(min(_CHUNK, size - look), look)
                found = chunk.find(MAGIC)
                at = look + found if found >= 0 else size
                look += max(1, len(chunk) - 2)


def _member(f, at: int, size: int) -> tuple[bytes, int] | None:
    """The member at this place, unpacked, and where it ends; None if none is there that begins as a record."""
    first = f.read_at(min(_PROBE, size - at), at)
    if not first.startswith(MAGIC):
        return None
    unpacker = zlib.decompressobj(31)
    try:
        data = [unpacker.decompress(first)]
        if not data[0].startswith(VERSION[:5]):
            return None
        look = at + len(first)
        while not unpacker.eof and look < size:
            chunk = f.read_at(min(_CHUNK, size - look), look)
            data.append(unpacker.decompress(chunk))
            look += len(chunk)
    except zlib.error:
        return None
    return (b"".join(data), look - len(unpacker.unused_data)) if unpacker.eof else None


def is_record(data: bytes) -> bool:
    """Whether an unpacked member has a header with all that a record needs, and as many bytes as that says."""
    fields = decode_header(data)
    return fields is not None and len(data) >= data.index(END + END) + 4 + int(fields["content-length"])


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """archives: path and bytes. Gives page_id, url, payload_bytes, payload_digest, record_type and refers_to."""
    ranges = archives.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = max(1, ranges.count())
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("stop")).repartition(n)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in it:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for data in read_range(path, start, stop):
                    rows.append(decode_record(data))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return ranges.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages into archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc")))

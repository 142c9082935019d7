"""WARC members that are no whole records, damaged bytes between members, and odd rows."""

import gzip
import hashlib
import io

from framegauge.llm import warc
from framegauge.llm.store import fresh_path


class _Memory(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def _member(data):
    blob = gzip.compress(data)
    found = warc._member(_Memory(blob), 0, len(blob))
    return found if found and warc.is_record(found[0]) else None


def test_members_without_a_whole_header_are_skipped():
    record = gzip.decompress(warc.encode_record(7, "u", b"payload", None))
    assert _member(record)[0] == record and warc.decode_record(record)[:3] == (7, "u", 7)
    for gone in (b"Content-Length: 8", b"WARC-Type: response", b"WARC-Record-ID: <urn:page:7>"):
        if gone in record:
            assert _member(record.replace(gone, b"X-Other: 1")) is None
    assert _member(record[: record.rindex(b"Content-Length")] + b"\r\n\r\n") is None
    assert _member(record[:-10]) is None and _member(b"WARC/1.1\r\n") is None and _member(b"WARC/" + b"x" * 200_000) is None and _member(b"") is None
    late = record.replace(b"WARC-Date", b"X-Long: " + b"y" * 40_000 + b"\r\nWARC-Date")
    assert _member(late)[0] == late


def test_revisits_without_digest_have_nulls():
    record = gzip.decompress(warc.encode_record(7, None, b"p" * 2000, 9))
    assert warc.decode_record(record)[2:] == (2000, hashlib.sha1(b"p" * 2000).hexdigest(), "revisit", 9)
    bare = record.replace(b"WARC-Payload-Digest", b"X-Digest").replace(b"Content-Length: 2000", b"X-Length: 2000     ")
    assert warc.decode_record(bare)[2:] == (None, None, "revisit", 9)


def test_damaged_bytes_between_members_and_odd_rows(spark, tmp_path):
    records = [warc.encode_record(i, "u", bytes([65 + i]) * 50_000, None) for i in range(5)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"junk" + records[0] + warc.MAGIC * 3 + records[1] + gzip.compress(b"WARC/1.0\r\nWARC-Type: info\r\n\r\n") + records[2] + records[3][:40] + records[4])
    archives = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, bytes long")
    for size in (50, 1000, 1 << 20):
        assert sorted(r.page_id for r in warc.read_archives(archives, size).collect()) == [0, 1, 2, 4]
    rows = [(1, "u", "x" * 3_000_000, 5, "z"), (2, "u", "x" * 3_000_000, 6, "z"), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int, keep string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.archive_round_trip(pages).collect())
    assert got == [("1", 3_000_000, "revisit", "2"), ("2", 3_000_000, "response", "None"), ("None", 0, "response", "None")]
    assert warc.read_archives(warc.write_archives(pages.limit(0), fresh_path(spark, "warc"))).count() == 0

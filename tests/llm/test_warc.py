import base64
import gzip
import hashlib
import io
import zlib

import pytest

from corvane.llm import warc


def made(payload=b"<p>x</p>" * 300, refers_to=None):
    return warc.record(5, "http://a.example/ü x", payload, hashlib.sha1(payload).digest(), refers_to, "2000-01-01T00:00:00Z")


def test_record_is_a_gzip_member_with_standard_headers():
    payload = b"<p>x</p>"
    text = gzip.decompress(made(payload))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(payload + b"\r\n\r\n")
    assert b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()) in text


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_reader_streams_members(chunk, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    got = list(warc.read_archive(io.BytesIO(made() + made(b"") + made(refers_to=9)), payloads=True))
    assert [(r["record_type"], r["payload_bytes"], r["refers_to"], len(r["payload"])) for r in got] == [("response", 2400, None, 2400), ("response", 0, None, 0), ("revisit", 2400, 9, 0)]
    assert got[0]["payload_digest"] == got[2]["payload_digest"] == hashlib.sha1(b"<p>x</p>" * 300).hexdigest()


def broken(change):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(change(gzip.decompress(made()))) + packer.flush()


@pytest.mark.parametrize("data", [made()[:-9], broken(lambda x: x.replace(b"<p>x", b"<p>y", 1)), broken(lambda x: x[:-6]), broken(lambda x: x + b"z"), broken(lambda x: x.replace(b"WARC/1.1", b"WARC/9.9"))])
def test_reader_refuses_damage(data):
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_archive(io.BytesIO(data)))


@pytest.mark.parametrize("broadcast_groups", [0, warc.GROUPS])
def test_round_trip_with_revisits(spark, tmp_path, broadcast_groups):
    big, small = "é" * 600, "s" * 999
    rows = [(1, "u", big), (2, "u", big), (7, None, big), (None, "u", big), (3, "u", small), (4, "u", small), (5, "u", None), (None, "n", "N" * 2000), (None, "n", "N" * 2000), (9, "r", "R" * 1500), (9, "r", "R" * 1500), (20, "l", "<p>" * 900_000)]
    pages = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, sha1 string, URL string")
    folder = f"file://{tmp_path}"
    made = warc.write(pages, folder, archive_bytes=100, broadcast_groups=broadcast_groups).collect()
    assert sum(r.records for r in made) == len(rows)
    got = warc.read(spark.createDataFrame(made), folder, payloads=True).collect()
    seen = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0, len(r.payload)) for r in got)
    assert seen == sorted([(1, 1200, "revisit", 7, 0), (2, 1200, "revisit", 7, 0), (7, 1200, "response", 0, 1200), (0, 1200, "revisit", 7, 0), (3, 999, "response", 0, 999), (4, 999, "response", 0, 999), (5, 0, "response", 0, 0), (0, 2000, "response", 0, 2000), (0, 2000, "response", 0, 2000), (9, 1500, "response", 0, 1500), (9, 1500, "response", 0, 1500), (20, 2_700_000, "response", 0, 2_700_000)])
    assert warc.write(pages.limit(0), folder).collect() == []

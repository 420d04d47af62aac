"""WARC archives: one gzip member per record, written by each task, and a sequential reader with checked framing and digests.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is a response and the others are
revisits of it, without the payload. Which is which is settled on digests alone; payloads stay in the task that reads them, but for
very many groups of copies. The folder is the shared one, reached through Arrow's file systems; a file is written under the name of its task
attempt and renamed when it is whole, so an attempt that is lost leaves no half archive under a final name.

The reader inflates a member a chunk at a time, takes the header up to its blank line, the block by its content length, and
two line ends; it fails on a short or overlong member, on a wrong block digest and on a wrong payload digest. It holds one
chunk, and the payload only if asked.

Defined results: a null html is an empty payload, a null url an empty target. Records with a null page_id revisit like others;
where all equal payloads have null ids, all are responses. Rows repeated under the largest page_id are all responses. Further
columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common

CHUNK, LEAST, SALTS, GROUPS = 1 << 20, 1000, 16, 200_000
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str, payload: bytes, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    """A record as one gzip member; a revisit, where refers_to is given, has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    header = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": labelled(sha1),
        "WARC-Block-Digest": labelled(hashlib.sha1(block).digest()),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        header |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in header.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + END) + packer.flush()


class Member:
    """Exact reads from the gzip member that begins where the last one ended; holds a chunk of input and what is inflated of it."""

    def __init__(self, source, rest: bytes) -> None:
        self.source, self.input, self.inflater, self.ready = source, rest, zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.inflater.eof:
            return False
        if not self.input:
            self.input = self.source.read(CHUNK)
            if not self.input:
                raise ValueError("the archive ends within a record")
        self.ready += self.inflater.decompress(self.input, CHUNK)
        self.input = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                raise ValueError("a header has no end")
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise ValueError("a block is shorter than its content length")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part

    def close(self) -> bytes:
        """What follows the member, which must be at its end."""
        while self.more():
            pass
        if self.ready:
            raise ValueError("a block is longer than its content length")
        return self.input


def fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def read_archive(source, payloads: bool = False) -> Iterator[dict]:
    """The records of an open archive in order: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload if asked."""
    rest = b""
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">") or -1) if x and x != "<urn:page:>" else None
    while rest or (rest := source.read(CHUNK)):
        member = Member(source, rest)
        top = member.until(END)
        if not top.startswith(VERSION + b"\r\n"):
            raise ValueError("not a record of this version")
        header = fields(top)
        left, block = int(header["content-length"]), hashlib.sha1()
        http = b""
        body, parts, size = hashlib.sha1(), [], 0
        for part in member.exactly(left):
            block.update(part)
            if http is not None:
                http += part
                if (at := http.find(END)) < 0:
                    continue
                inner, part, http = fields(http[:at]), http[at + len(END) :], None
            body.update(part)
            size += len(part)
            if payloads:
                parts.append(part)
        if b"".join(member.exactly(len(END))) != END:
            raise ValueError("a block is longer than its content length")
        rest = member.close()
        if http is not None or labelled(block.digest()) != header["warc-block-digest"]:
            raise ValueError(f"the block of {header['warc-record-id']} does not have its digest")
        revisit = header["warc-type"] == "revisit"
        if not revisit and (labelled(body.digest()) != header["warc-payload-digest"] or size != int(inner["content-length"])):
            raise ValueError(f"the payload of {header['warc-record-id']} does not have its digest or length")
        yield {
            "page_id": number(header["warc-record-id"]),
            "url": header["warc-target-uri"],
            "record_type": header["warc-type"],
            "payload_bytes": int(inner["content-length"]),
            "payload_digest": base64.b32decode(header["warc-payload-digest"].removeprefix("sha1:")).hex(),
            "refers_to": number(header.get("warc-refers-to", "")),
        } | ({"payload": b"".join(parts)} if payloads else {})


def decided(pages: DataFrame, least: int = LEAST, broadcast_groups: int = GROUPS) -> DataFrame:
    """page_id, url, body, sha1, refers_to (null for responses).

    Up to `broadcast_groups` groups of equal payloads go to all tasks, and no payload moves; beyond that number the payloads of `least` bytes
    or more are dealt by digest and salt, shorter ones stay where they are.
    """
    own = common.pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), common.as_bytes(F.col("html")).alias("body"))
    own = own.withColumn("sha1", F.unhex(F.sha1("body")))
    long = F.octet_length("body") >= least
    groups = own.where(long).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = common.cut(groups.select("sha1", "first"))
    refers = F.when(long & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")
    if groups.count() <= broadcast_groups:
        out = own.join(F.broadcast(groups), "sha1", "left")
    else:
        groups = groups.select("sha1", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = own.where(long).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        out = salted.join(groups, ["sha1", "salt"], "left").drop("salt").unionByName(own.where(~long).withColumn("first", F.lit(None).cast("long")))
    return out.select("page_id", "url", "body", "sha1", refers)


def write(pages: DataFrame, folder: str, least: int = LEAST, broadcast_groups: int = GROUPS, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = 1 << 30) -> DataFrame:
    """path, records of the archives written: each task's records in files of about `archive_bytes`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, made, out, n, size = TaskContext.get(), 0, None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            final = posixpath.join(root, f"{task.partitionId():05d}-{made:03d}-{task.taskAttemptId()}.warc.gz")
            store.move(part, final)
            return pa.RecordBatch.from_arrays([pa.array([posixpath.basename(final)]), pa.array([n], pa.int64())], ["path", "records"])

        for batch in batches:
            for page_id, url, body, sha1, refers_to in zip(*batch.columns, strict=True):
                if out is None:
                    part = posixpath.join(root, f"_{task.partitionId():05d}-{made:03d}-{task.taskAttemptId()}")
                    out, n, size = store.open_output_stream(part, compression=None), 0, 0
                one = record(page_id.as_py(), url.as_py(), body.as_py(), sha1.as_py(), refers_to.as_py(), date)
                out.write(one)
                n, size = n + 1, size + len(one)
                if size >= archive_bytes:
                    yield close()
                    made, out = made + 1, None
        if out is not None:
            yield close()

    return decided(pages, least, broadcast_groups).mapInArrow(run, "path string, records long")


def read(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the archives named in column path, one after the other."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    target = common._arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                held, size = [], 0
                with store.open_input_stream(posixpath.join(root, path), compression=None) as source:
                    for one in read_archive(source, payloads):
                        held.append(one)
                        size += len(one.get("payload", b""))
                        if len(held) >= 5000 or size > 16 * CHUNK:
                            yield pa.RecordBatch.from_pylist(held, schema=target)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=target)

    return archives.select("path").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = common.cut(write(common.table(spark, sf_dir, "pages"), folder))
    return read(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first, count(*) OVER (PARTITION BY payload_digest) AS copies FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND copies > 1 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND copies > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""

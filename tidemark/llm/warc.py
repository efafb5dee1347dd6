"""WARC archives: a writer with revisit records and a sequential, verifying reader.

Each record is a gzip member of its own. The reader takes compressed chunks in order, decompresses them incrementally,
frames each record by its Content-Length and checks the digests that it states as the payload streams past; memory stays within
a few chunks whatever a record's size. Records and their archive members agree one to one: a member that ends early, runs
on, lacks a header that every record has, or whose digest differs is an error.

The reader takes the archives of others too: records of any type, of which only those of HTTP messages have a header in the block; block and
payload digests of SHA-1, SHA-256 or MD5, in base 32 or 16, or none (other algorithms are not checked). The payload of a message is its body as it was
transferred.

Of pages with equal payloads of min_bytes or more the smallest id becomes a response, the others revisit it.
Archives go to the shared folder through the file system that its address names. Each task attempt writes names
of its own; only those in the manifest, which is written once, are read.

Defined results: a null text is an empty payload; a null id is never revisited nor a revisit; rows with equal id and payload are
all responses or all revisits, and one record stored again, with one record id; an empty table gives no archives and no rows; columns other
than id, url and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_key_join, shared_path, slices, written

CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-tidemark:page:"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, archive string, offset long"


class WarcError(ValueError):
    """A record or archive that doesn't hold what it states."""


def urn_of(page_id: int | None, digest: str) -> str:
    return f"<{URN}{uuid.uuid4().hex if page_id is None else page_id}:{digest[:16]}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with one record; a revisit states the payload's size and digest without holding it."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else "%" + format(ord(c), "02X") for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn_of(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn_of(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packer.compress("\r\n".join(head).encode() + b"\r\n\r\n"), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()])


class Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, fill: Callable[[], bytes], head: bytes):
        self.fill, self.unpacker, self.left, self.buffer = fill, zlib.decompressobj(31), head, b""

    def more(self) -> bool:
        """Decompresses up to a chunk; false at the member's end."""
        while not self.unpacker.eof:
            pending = self.unpacker.unconsumed_tail or self.left or self.fill()
            self.left = b""
            if not pending:
                raise WarcError("the archive ends within a member")
            try:
                new = self.unpacker.decompress(pending, CHUNK)
            except zlib.error as e:
                raise WarcError(str(e)) from e
            if new:
                self.buffer += new
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if len(self.buffer) > most or not self.more():
                raise WarcError("a header doesn't end")
        found, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise WarcError("a record is shorter than its Content-Length")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part

    def close(self) -> bytes:
        """Checks the record's end and returns what was read beyond the member."""
        if b"".join(self.take(4)) != b"\r\n\r\n" or self.buffer or self.more():
            raise WarcError("a record is longer than its Content-Length")
        return self.unpacker.unused_data


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def page_of(urn: str | None) -> int | None:
    """The page that a record id of this writer names."""
    name = (urn or "").strip("<>")
    found = name.removeprefix(URN).split(":")[0]
    return int(found) if name.startswith(URN) and re.fullmatch(r"-?\d{1,19}", found) else None


class Stated:
    """A digest that a record states, and what it is of the bytes that came past."""

    def __init__(self, stated: str | None):
        name, _, value = (stated or "").partition(":")
        self.value = value.strip()
        self.hash = hashlib.new(name.lower().replace("-", "")) if name.lower().replace("-", "") in ("sha1", "sha256", "md5") else None

    def update(self, part: bytes) -> None:
        if self.hash:
            self.hash.update(part)

    def differs(self) -> bool:
        if not self.hash:
            return False
        raw = self.hash.digest()
        return self.value.lower() != raw.hex() and self.value.upper().rstrip("=") != base64.b32encode(raw).decode().rstrip("=")


def number(headers_: dict[str, str], name: str) -> int | None:
    value = headers_.get(name)
    if value is not None and not re.fullmatch(r"\d{1,18}", value):
        raise WarcError(f"{name} is no number")
    return None if value is None else int(value)


def read_records(stream: BinaryIO, on_payload: Callable[[bytes], None] | None = None) -> Iterator[dict]:
    """The records of an archive in turn. on_payload gets the chunks of each payload before its record is given.

    payload_digest is the SHA-256 of the payload, of a revisit what it states (without the name of SHA-256); payload_bytes of a revisit is what its
    HTTP header states, or null.
    """
    position, head = 0, b""

    def fill() -> bytes:
        nonlocal position
        new = stream.read(CHUNK)
        position += len(new)
        return new

    while True:
        head = head or fill()
        if not head:
            return
        start = position - len(head)
        member = Member(fill, head)
        warc = headers(member.until(b"\r\n\r\n"))
        if not warc[""].startswith("WARC/"):
            raise WarcError("not a WARC record")
        length, kind, name = number(warc, "content-length"), warc.get("warc-type"), warc.get("warc-record-id")
        if length is None or not kind or not name:
            raise WarcError("a record lacks its type, id or length")
        block, payload, http, raw = Stated(warc.get("warc-block-digest")), Stated(warc.get("warc-payload-digest")), {}, b""
        if length and warc.get("content-type", "").lower().startswith("application/http"):
            raw = member.until(b"\r\n\r\n") + b"\r\n\r\n"
            http = headers(raw[:-4])
            block.update(raw)
        rest = length - len(raw)
        if rest < 0:
            raise WarcError("the HTTP header exceeds the record")
        sha, size, revisit = hashlib.sha256(), 0, kind == "revisit"
        for part in member.take(rest):
            for x in (sha, block, payload):
                x.update(part)
            size += len(part)
            if on_payload:
                on_payload(part)
        head = member.close()
        if block.differs() or not revisit and payload.differs():
            raise WarcError(f"{name}: payload and digest differ")
        digest = warc.get("warc-payload-digest", "").removeprefix("sha256:") or None if revisit else sha.hexdigest()
        yield {"page_id": page_of(name), "url": warc.get("warc-target-uri"), "payload_bytes": number(http, "content-length") if revisit else size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(warc.get("warc-refers-to")), "record_id": name.strip("<>"), "offset": start}


def write_archives(pages: DataFrame, min_bytes: int = 100, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the manifest: archive, n_records, n_bytes."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    whole = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("html")).withColumn("digest", F.sha2("html", 256))
    keys = written(whole.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest"), "digests")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = hot_key_join(keys, firsts, ["digest"], "n", keys.count()).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    rows = whole.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    root = shared_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        out, name, n, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n], "n_bytes": [size]})

        for batch in slices(batches):
            for page_id, url, html, digest, refers_to in zip(*(batch.column(k) for k in range(5))):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                member = record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py())
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    manifest = written(rows.mapInArrow(write, "archive string, n_records long, n_bytes long"), "manifest")
    return manifest.withColumn("archive", F.concat(F.lit(root + "/"), "archive"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives in a manifest (archive, n_records; a null number isn't checked), each archive read by one task from its start to its end."""
    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = fs.FileSystem.from_uri(address)
                n, rows = 0, []

                def packed(rows: list[dict], address: str = address) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r.get(c, address) for r in rows], kinds.get(c, pa.string())) for c in names], names=names)

                with store.open_input_stream(path, compression=None) as stream:
                    for row in read_records(stream):
                        rows.append(row)
                        n += 1
                        if len(rows) == 1024:
                            yield packed(rows)
                            rows = []
                if expected not in (None, n):
                    raise WarcError(f"{address} holds {n} records, its manifest {expected}")
                if rows:
                    yield packed(rows)

    return manifest.select("archive", "n_records").repartition(tasks).mapInArrow(read, RECORDS)

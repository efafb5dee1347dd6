"""Media columns: payloads as 8-bit grey PNG members of ZIP archives, read by a data source of byte ranges.

The writer stores each payload losslessly in a PNG of 64 samples a row and puts the PNGs, stored, into ZIP archives in
the shared folder; the manifest, which a job commits as a whole, names the finished ones. The data source `media_archive` plans byte ranges
from the sizes in the manifest, or without one from a folder's files; a task finds the members that begin in its range in the
archive's directory, reads neighbours together, and gives batches of bounded bytes through Arrow. A member whose read or CRC fails
is read again by its own offset, with a new handle, up to `attempts` times; the others aren't read again. What a lost writer leaves is in no
manifest and is never opened.

Defined results: a null or empty text is 64 zero bytes; a null id stays null; repeated rows are members of their
own; an empty table gives no archives and no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_path, slices, written

ROW = 64
BATCH_BYTES = 8 << 20
MAX_MEMBERS = 60_000
MEMBERS = "archive string, offset long, name string, media binary"

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
#: After the signature: versions, flags, method, time, date (1980-01-01), crc, sizes, lengths of name and extra.
LOCAL_FIELDS, CENTRAL_FIELDS, END_FIELDS = "<HHHHHIIIHH", "<HHHHHHIIIHHHHHII", "<HHHHIIH"


class MediaError(ValueError):
    """A member that doesn't hold what its directory or its checksums state."""


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """A grey PNG, 64 samples wide, with the unpadded length as text."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    rows = np.zeros((len(samples), ROW + 1), np.uint8)
    rows[:, 1:] = samples
    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"Length\0%d" % n_bytes) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of what to_png() gives; checks every chunk."""
    if media[:8] != PNG_MAGIC:
        raise MediaError("not a PNG")
    at, parts, height, n_bytes = 8, [], 0, None
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise MediaError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if width != ROW or rest != [8, 0, 0, 0, 0]:
                raise MediaError("not 8-bit grey of 64 samples a row")
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            n_bytes = int(body[7:])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, ROW + 1)
    if len(rows) != height or rows[:, 0].any() or n_bytes is None:
        raise MediaError("rows are missing or filtered, or the length is not stated")
    return rows[:, 1:].tobytes(), n_bytes


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, mean step between neighbours, and shares of 16 ranges, in thousandths."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share, level = counts / len(samples), np.arange(256)
    mean = float(share @ level)
    deviation = float(share @ (level - mean) ** 2) ** 0.5
    some = share[share > 0]
    entropy = float(-(some * np.log2(some)).sum())
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    shares = ",".join(str(round(1000 * x)) for x in share.reshape(16, 16).sum(axis=1).tolist())
    return f"mean={mean:.3f};std={deviation:.3f};entropy={entropy:.3f};step={step:.3f};hist={shares}"


def write_archives(docs: DataFrame, archive_bytes: int = 256 << 20) -> tuple[str, DataFrame]:
    """Writes the texts of docs (doc_id, text) and returns the folder and the manifest: archive, n_members, n_bytes."""
    spark = docs.sparkSession
    root = shared_path(spark, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        out, name, at, directory = None, "", 0, []

        def closed() -> pa.RecordBatch:
            body = b"".join(directory)
            out.write(body + END + struct.pack(END_FIELDS, 0, 0, len(directory), len(directory), len(body), at, 0))
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "n_members": [len(directory)], "n_bytes": [at + len(body) + 22]})

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    name, at, directory = f"{uuid.uuid4().hex}.zip", 0, []
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                data = (text.as_py() or "").encode()
                media, member = to_png(padded(data), len(data)), f"{'' if doc_id is None else doc_id}.png".encode()
                crc, size = zlib.crc32(media), len(media)
                out.write(LOCAL + struct.pack(LOCAL_FIELDS, 20, 0, 0, 0, 33, crc, size, size, len(member), 0) + member + media)
                directory.append(CENTRAL + struct.pack(CENTRAL_FIELDS, 20, 20, 0, 0, 0, 33, crc, size, size, len(member), 0, 0, 0, 0, 0, at) + member)
                at += 30 + len(member) + size
                if at >= archive_bytes or len(directory) >= MAX_MEMBERS:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return root, written(rows.mapInArrow(write, "archive string, n_members long, n_bytes long"), "media-manifest")


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.manifest = options.get("manifest")
        self.range_bytes = int(options.get("rangebytes", 64 << 20))
        self.attempts = int(options.get("attempts", 3))

    def sizes(self) -> list[tuple[str, int]]:
        """(name, bytes) of each archive to read."""
        if self.manifest:
            store, folder = fs.FileSystem.from_uri(self.manifest)
            files = [x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.is_file and x.extension == "parquet"]
            return sorted(row for f in files for row in zip(*pq.read_table(f, columns=["archive", "n_bytes"], filesystem=store).to_pydict().values()))
        store, folder = fs.FileSystem.from_uri(self.root)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted((x.base_name, x.size) for x in found if x.is_file and x.extension == "zip")

    def partitions(self) -> list[ByteRange]:
        ranges = [ByteRange(f"{self.root}/{name}", at, at + self.range_bytes) for name, size in self.sizes() for at in range(0, size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        store, path = fs.FileSystem.from_uri(part.archive)
        rows, size = [], 0
        with store.open_input_file(path) as file:
            for group in neighbours([x for x in directory_of(file) if part.start <= x[1] < part.end]):
                for name, offset, media in self._members(store, path, file, group):
                    rows.append((part.archive, offset, name, media))
                    size += len(media)
                    if size >= BATCH_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
        if rows:
            yield packed(rows)

    def _members(self, store, path: str, file, group: list[tuple]) -> Iterator[tuple[str, int, bytes]]:
        start = group[0][1]
        try:
            block = file.read_at(group[-1][1] + member_bytes(group[-1]) - start, start)
        except OSError:
            block = b""
        for entry in group:
            name, offset, _, _ = entry
            try:
                yield name, offset, media_of(block[offset - start : offset - start + member_bytes(entry)], entry)
            except MediaError as first:
                yield name, offset, self._again(store, path, entry, first)

    def _again(self, store, path: str, entry: tuple, error: Exception) -> bytes:
        for _ in range(self.attempts):
            try:
                with store.open_input_file(path) as file:
                    return media_of(file.read_at(member_bytes(entry), entry[1]), entry)
            except (MediaError, OSError) as e:
                error = e
        raise MediaError(f"{path}, member at {entry[1]}: {error}")


def member_bytes(entry: tuple) -> int:
    return 30 + len(entry[0].encode()) + entry[2]


def directory_of(file) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset, size, crc) of each member, from the archive's directory."""
    end = file.read_at(22, max(0, file.size() - 22))
    if len(end) < 22 or end[:4] != END:
        raise MediaError("the archive has no directory")
    _, _, _, n, size, start, _ = struct.unpack_from(END_FIELDS, end, 4)
    body, at = file.read_at(size, start), 0
    for _ in range(n):
        *_, crc, stored, _, n_name, n_extra, n_comment, _, _, _, offset = struct.unpack_from(CENTRAL_FIELDS, body, at + 4)
        yield body[at + 46 : at + 46 + n_name].decode(), offset, stored, crc
        at += 46 + n_name + n_extra + n_comment


def neighbours(entries: list[tuple], most: int = BATCH_BYTES) -> Iterator[list[tuple]]:
    group: list[tuple] = []
    for entry in sorted(entries, key=lambda x: x[1]):
        if group and entry[1] + entry[2] - group[0][1] > most:
            yield group
            group = []
        group.append(entry)
    if group:
        yield group


def media_of(member: bytes, entry: tuple) -> bytes:
    name, _, size, crc = entry
    if len(member) < member_bytes(entry) or member[:4] != LOCAL:
        raise MediaError("no member begins here")
    media = member[-size:]
    if zlib.crc32(media) != crc:
        raise MediaError("a member's checksum differs")
    return media


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "offset", "name", "media"])


class MediaArchives(DataSource):
    """format("media_archive").load(folder); options manifest (a folder of Parquet with archive and n_bytes), rangeBytes and attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """The members of the archives in a folder; with a manifest as write_archives gives it, only of the archives it lists."""
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archive")
    if manifest is not None:
        reader = reader.option("manifest", manifest.inputFiles()[0].rsplit("/", 1)[0])
    return reader.load(root)


def described(members: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of the stored media."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for name, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                media = media.as_py()
                payload, n_bytes = from_png(media)
                doc_id = name.removesuffix(".png")
                rows.append((int(doc_id) if doc_id else None, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return members.select("name", "media").mapInArrow(describe, schema)

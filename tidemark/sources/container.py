"""Recording containers: a splittable data source, a writer, and the decoding of records by expression.

format("recording") reads a file or folder. Byte ranges are planned from file sizes alone: every segment begins with a SYNC frame
and restates its schemas, so a task looks for the first valid SYNC in each of its ranges and reads whole segments from there. Ranges of splitBytes
each are dealt to tasks in runs of TASK_BYTES, so that small ones don't make a task each. Views:
`records` (default), `frames`, `stats` (per frame and field, computed on the frame's arrays), `index` (per frame, with its axis extent and the
statistics of all fields), `streams`, `runs`, `meta`, `attachments`. Records stay binary; decode() turns them into
columns by Catalyst expressions, so fields that a query doesn't name are never decoded.

A torn tail ends the file at its last intact frame. Unknown frames, codecs, filters and invalid schemas are reported in the `frames`
view as unsupported and skipped; they never fail a job. Options: view, stream, splitBytes, resync (for slices without a header), from and to
(frames that can't meet this axis window aren't decompressed; records are still to be filtered), places (JSON: only these files, each from
the place of a SYNC on). Equality filters on file, segment, stream and run_id are pushed: frames that they rule out aren't decompressed.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..functions import axis as axes
from ..functions import bits
from ..model import AXIS_KINDS, AXIS_MODES, CONVERSIONS, TYPES, Conversion, Field, Schema, SchemaError
from . import arrays, codec

#: Fixed values of the format.
MAGIC = bytes.fromhex("894c4f47420d0a1a")
TOKEN = bytes.fromhex("4c4f474253594e43a73e91d25c680bf4")
SYNC, SCHEMA, META, ATTACH, RUN, DATA, INDEX, END = 0x01, 0x10, 0x11, 0x12, 0x13, 0x20, 0x30, 0x40
NAMES = {SYNC: "SYNC", SCHEMA: "SCHEMA", META: "META", ATTACH: "ATTACH", RUN: "RUN", DATA: "DATA", INDEX: "INDEX", END: "END", 0x50: "SIGN"}

#: A task reads ranges of a file of about so many bytes; a batch ends at so many records or bytes.
TASK_BYTES, BATCH_RECORDS, BATCH_BYTES = 1 << 20, 8192, 8 << 20

VIEWS = {
    "records": "file string, segment long, frame_offset long, rec_idx int, stream string, run_id long, axis_tick long, axis_value double, record binary, tails array<binary>",
    "frames": "file string, segment long, frame_offset long, type string, stream string, run_id long, count long, axis_tick long, axis_value double, payload_bytes long, unsupported string",
    "stats": "file string, segment long, frame_offset long, stream string, run_id long, count long, axis_tick long, axis_value double, field string, n_present long, low double, high double, first_value double, last_value double, several boolean",
    "index": "file string, segment long, sync long, frame_offset long, frame_bytes long, stream string, layout long, run_id long, count long, axis_tick long, axis_value double, axis_low double, axis_high double, fields array<struct<field:string,n_present:long,low:double,high:double,first_value:double,last_value:double,several:boolean>>",
    "streams": "file string, segment long, stream string, name string, record_bits int, n_fields int, axis_kind string, axis_mode string, axis_exp int, axis_unit string, schema binary",
    "runs": "file string, segment long, run_id long, run_index long, params map<string,string>",
    "meta": "file string, segment long, frame_offset long, key string, value string",
    "attachments": "file string, segment long, frame_offset long, name string, data binary",
}


class Bytes:
    """Reads little-endian values in turn."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("a payload ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def get(self, code: str) -> Any:
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def text(self) -> str:
        return self.take(self.get("I")).decode("utf-8", "replace")

    def pairs(self) -> tuple[tuple[str, str], ...]:
        return tuple((self.text(), self.text()) for _ in range(self.get("I")))


def put_text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<I", len(raw)) + raw


def put_pairs(pairs) -> bytes:
    rows = sorted(pairs)
    return struct.pack("<I", len(rows)) + b"".join(put_text(k) + put_text(v) for k, v in rows)


def parse_conversion(b: Bytes) -> Conversion:
    kind = CONVERSIONS[b.get("B")]
    if kind == "identity":
        return Conversion()
    if kind in ("linear", "rational"):
        return Conversion(kind, tuple(b.get("d") for _ in range(2 if kind == "linear" else 6)))
    n = b.get("I")
    if kind in ("table", "table_interp"):
        rows = [(b.get("d"), b.get("d")) for _ in range(n)]
        return Conversion(kind, (tuple(k for k, _ in rows), tuple(v for _, v in rows)))
    rows = tuple((*(b.get("d") for _ in range(1 if kind == "value_to_text" else 2)), b.text()) for _ in range(n))
    return Conversion(kind, (rows, b.text()))


def put_conversion(c: Conversion) -> bytes:
    out = bytes([CONVERSIONS.index(c.kind)])
    if c.kind in ("linear", "rational"):
        return out + struct.pack(f"<{len(c.params)}d", *c.params)
    if c.kind in ("table", "table_interp"):
        return out + struct.pack("<I", len(c.params[0])) + b"".join(struct.pack("<dd", k, v) for k, v in zip(*c.params))
    if c.kind != "identity":
        rows, default = c.params
        return out + struct.pack("<I", len(rows)) + b"".join(struct.pack(f"<{len(r) - 1}d", *r[:-1]) + put_text(r[-1]) for r in rows) + put_text(default)
    return out


def parse_schema(payload: bytes) -> Schema:
    b = Bytes(payload)
    stream, name, record_bits = str(uuid.UUID(bytes=b.take(16))), b.text(), b.get("I")
    kind, mode, exponent, _ = b.get("B"), b.get("B"), b.get("b"), b.get("B")
    unit, step, scale, axis_field, n = b.text(), b.take(8), b.take(8), b.get("H"), b.get("H")
    if kind >= len(AXIS_KINDS) or mode >= len(AXIS_MODES):
        raise SchemaError(f"{name}: unknown axis")
    number = (lambda raw: struct.unpack("<q", raw)[0]) if AXIS_KINDS[kind] == "time" else (lambda raw: struct.unpack("<d", raw)[0])
    fields = []
    for _ in range(n):
        label, offset, width, type_, order, flags = b.text(), b.get("I"), b.get("I"), b.get("B"), b.get("B"), b.get("B")
        unit_, desc, conversion = b.text(), b.text(), parse_conversion(b)
        guard = (b.get("H"), b.get("Q")) if flags & 2 else None
        if type_ >= len(TYPES):
            raise SchemaError(f"{label}: unknown type {type_}")
        fields.append(Field(label, offset, width, TYPES[type_], bool(order), bool(flags & 1), guard, conversion, unit_, desc, b.pairs()))
    return Schema(stream, name, record_bits, tuple(fields), AXIS_KINDS[kind], AXIS_MODES[mode], exponent, unit, number(step), number(scale), axis_field, b.pairs()).validate()


def put_schema(s: Schema) -> bytes:
    number = "<q" if s.timed else "<d"
    out = [uuid.UUID(s.uuid).bytes, put_text(s.name), struct.pack("<IBBbB", s.record_bits, AXIS_KINDS.index(s.axis_kind), AXIS_MODES.index(s.axis_mode), s.axis_exp, 0), put_text(s.axis_unit), struct.pack(number, s.axis_step), struct.pack(number, s.axis_scale), struct.pack("<HH", s.axis_field, len(s.fields))]
    for f in s.fields:
        out += [put_text(f.name), struct.pack("<IIBBB", f.offset, f.width, TYPES.index(f.type), f.big_endian, f.variable | 2 * bool(f.guard)), put_text(f.unit), put_text(f.desc), put_conversion(f.conversion)]
        out += [struct.pack("<HQ", *f.guard)] if f.guard else []
        out.append(put_pairs(f.meta))
    return b"".join([*out, put_pairs(s.meta)])


def frame(type_: int, payload: bytes, stream: int = 0) -> bytes:
    body = struct.pack("<IBBH", len(payload), type_, 0, stream) + payload
    return body + struct.pack("<I", codec.crc32c(body))


def header() -> bytes:
    body = MAGIC + struct.pack("<HH", 0, 1)
    return body + struct.pack("<I", codec.crc32c(body))


def sync(seq: int, wall: int) -> bytes:
    return frame(SYNC, TOKEN + struct.pack("<Qq", seq, wall))


def data_frame(schema: Schema, stream: int, base, records: list[bytes] | bytes, tails: list[list[bytes]] | None = None, run: int = 0, codec_: int = codec.ZSTD, transposed: bool = True) -> bytes:
    """records: one by one, or end to end."""
    fixed = records if isinstance(records, bytes) else b"".join(records)
    count = len(fixed) // schema.record_bytes if schema.record_bytes else len(tails or records)
    fixed = codec.transpose(fixed, schema.record_bytes) if transposed else fixed
    raw = fixed + b"".join(struct.pack("<I", len(x)) + x for row in tails or [] for x in row)
    start = struct.pack("<q" if schema.timed else "<d", base)
    return frame(DATA, start + struct.pack("<IIBBHQ", count, run, codec_, transposed, 0, len(raw)) + codec.compress(raw, codec_), stream)


#: Every segment restates its schemas: those up to this size aren't worked out again.
RESTATED_BYTES = 1 << 16
restated_crc32c, restated_schema = lru_cache(maxsize=64)(codec.crc32c), lru_cache(maxsize=64)(parse_schema)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_states(path: str) -> list[tuple[str, int, int]]:
    """(file, size, time of its last change in nanoseconds) of a file or of all in a folder; hidden ones, in hidden folders too, are left out."""
    store, inner = open_store(path)
    info = store.get_file_info(inner)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(inner, recursive=True))
    start = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((start + x.path, x.size, x.mtime_ns or 0) for x in found if x.is_file and not any(part.startswith(("_", ".")) for part in (x.path[len(inner) :] if not info.is_file else x.base_name).split("/")))


def list_files(path: str) -> list[tuple[str, int]]:
    return [(p, n) for p, n, _ in list_states(path)]


def overwrite_bytes(path: str, frames: list[int], at: int, step: int = 4 << 20) -> None:
    """Inverts the byte `at` bytes into each of the frames of a file, to test what damage costs. The file is replaced by a copy, made a block at a time."""
    store, inner = open_store(path)
    places, begin = sorted(start + at for start in frames), 0
    folder, _, name = inner.rpartition("/")
    copy = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_input_file(inner) as file, store.open_output_stream(copy, compression=None) as out:
        while block := bytearray(file.read_at(step, begin)):
            for place in places[bisect_left(places, begin) : bisect_left(places, begin + len(block))]:
                block[place - begin] ^= 255
            out.write(bytes(block))
            begin += len(block)
    store.move(copy, inner)


def check_header(head: bytes, path: str) -> None:
    if len(head) < 16 or head[:8] != MAGIC:
        raise ValueError(f"{path}: not a recording")
    major, _, crc = struct.unpack("<HHI", head[8:16])
    if crc != codec.crc32c(head[:12]) or major:
        raise ValueError(f"{path}: damaged header or unknown major version")


class Walk:
    """Frames from a place on, with the state that SYNC, SCHEMA and RUN set up."""

    def __init__(self, file, size: int, at: int, payloads: bool = True):
        self.file, self.size, self.at, self.payloads = file, size, at, payloads
        self.segment, self.sync, self.schemas, self.layouts, self.bad = -1, at, {}, {}, {}

    def resume(self, end: int) -> bool:
        """Goes on at the next intact SYNC before end, after a frame that is torn or damaged; its segment restates what is needed."""
        begin = next_sync(self.file, self.size, self.at + 1, end)
        self.at = self.at if begin is None else begin
        return begin is not None

    def frames(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(offset, type, stream id, payload) up to the first that is torn or damaged."""
        while self.at + 12 <= self.size:
            head = self.file.read_at(8, self.at)
            n, type_, _, stream = struct.unpack("<IBBH", head)
            if self.at + 12 + n > self.size:
                return
            rest = self.file.read_at(n + 4, self.at + 8)
            checksum = restated_crc32c if type_ == SCHEMA and n <= RESTATED_BYTES else codec.crc32c
            if len(rest) < n + 4 or struct.unpack("<I", rest[n:])[0] != checksum(head + rest[:n]):
                return
            start, payload = self.at, rest[:n]
            self.at += 12 + n
            if type_ == SYNC:
                self.segment, self.sync, self.schemas, self.layouts, self.bad = struct.unpack("<Q", payload[16:24])[0], start, {}, {}, {}
            elif type_ == SCHEMA:
                try:
                    self.schemas[stream], self.layouts[stream] = (restated_schema if n <= RESTATED_BYTES else parse_schema)(payload), zlib.crc32(payload)
                except (ValueError, IndexError) as e:
                    self.bad[stream] = str(e)
            yield start, type_, stream, payload


def next_sync(file, size: int, start: int, end: int, step: int = 1 << 20) -> int | None:
    """Where the first intact SYNC frame in [start, end) begins."""
    at = start
    while at < end:
        block = file.read_at(min(min(step, end - at) + 64, size - at), at)
        found = -1
        while (found := block.find(TOKEN, found + 1)) >= 0:
            begin = at + found - 8
            if begin < start or begin >= end or begin + 44 > size:
                continue
            body = file.read_at(44, begin)
            if struct.unpack("<IB", body[:5]) == (32, SYNC) and struct.unpack("<I", body[40:])[0] == codec.crc32c(body[:40]):
                return begin
        at += step
    return None


def split_data(schema: Schema, payload: bytes) -> tuple[Any, int, int, bytes, list[list[bytes]] | None]:
    """(axis base, run, count, records end to end, tails)"""
    count, run, codec_, filter_, _, size = struct.unpack("<IIBBHQ", payload[8:28])
    base = struct.unpack("<q" if schema.timed else "<d", payload[:8])[0]
    if filter_ > 1:
        raise codec.UnsupportedCodec(f"filter {filter_}")
    raw, width = codec.decompress(payload[28:], codec_, size), schema.record_bytes
    fixed = codec.untranspose(raw[: count * width], width) if filter_ else raw[: count * width]
    if len(fixed) < count * width:
        raise ValueError("fewer records than stated")
    n = sum(f.variable for f in schema.fields)
    b = Bytes(raw[count * width :])
    return base, run, count, fixed, [[b.take(b.get("I")) for _ in range(n)] for _ in range(count)] if n else None


def outside(schema: Schema, payload: bytes, window: tuple[float, float]) -> bool:
    """Whether the frame's head alone shows that no record is in the window. Explicit axes don't show it."""
    base, count = struct.unpack("<qI" if schema.timed else "<dI", payload[:12])
    if schema.axis_mode == "explicit" or not count:
        return False
    last = base * schema.axis_step ** (count - 1) if schema.axis_mode == "log" else base + (count - 1) * schema.axis_step
    return max(base, last) < window[0] or min(base, last) > window[1]


def extent(schema: Schema, base, count: int, fixed: bytes) -> tuple[float | None, float | None]:
    """The least and greatest axis position of a frame's records, widened by what doubles may round of ticks."""
    if not count:
        return None, None
    terms = np.array([0.0])
    if schema.axis_mode == "explicit":
        terms = arrays.numbers(schema.fields[schema.axis_field], np.frombuffer(fixed, np.uint8).reshape(count, schema.record_bytes)) * schema.axis_scale
        terms = terms[~np.isnan(terms)]
        ends = [base + float(terms.min()), base + float(terms.max())] if len(terms) else [math.inf, math.inf]
    else:
        ends = [base, base * schema.axis_step ** (count - 1) if schema.axis_mode == "log" else base + (count - 1) * schema.axis_step]
    most = max(abs(float(x)) for x in (base, *ends, terms.min(initial=0), terms.max(initial=0)))
    room = 4 * float(np.spacing(most)) if math.isfinite(most) else 0.0
    return float(min(ends)) - room, float(max(ends)) + room


class Split(InputPartition):
    """The ranges of `step` bytes from start to end of a file."""

    def __init__(self, file: str, size: int, start: int, end: int, step: int):
        self.file, self.size, self.start, self.end, self.step = file, size, start, end, step


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.view = options["path"], options.get("view", "records")
        self.split_bytes, self.stream = int(options.get("splitbytes", 128 << 20)), options.get("stream")
        self.resync = options.get("resync", "false") == "true"
        self.window = float(options.get("from", "-inf")), float(options.get("to", "inf"))
        self.places = json.loads(options["places"]) if "places" in options else None
        self.equal: dict[str, set] = {}
        self.arrow = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in schema.fields])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """All stay with Spark as well, so that a filter that is taken here only saves work."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("file",), ("segment",), ("stream",), ("run_id",)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[f.attribute[0]] = wanted & self.equal.get(f.attribute[0], wanted)
            yield f

    def ruled_out(self, **values) -> bool:
        return any(k in self.equal and v not in self.equal[k] for k, v in values.items())

    def partitions(self) -> list[Split]:
        files = [(p, n, 0) for p, n in list_files(self.path)]
        if self.places is not None:
            files = [(p, n, self.places[p]) for p, n, _ in files if p in self.places]
        each = self.split_bytes * max(1, TASK_BYTES // self.split_bytes)
        out = [Split(p, n, at, min(at + each, n), self.split_bytes) for p, n, begin in files if not self.ruled_out(file=p) for at in range(begin, n, each)]
        return out or [Split("", 0, 0, 0, 1)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, path = open_store(part.file)
        with store.open_input_file(path) as file:
            if part.start == 0 and not self.resync:
                check_header(file.read_at(16, 0), part.file)
            frames = self.intact(file, part)
            if self.view == "records":
                yield from record_batches(((part.file, walk.segment, at, *found) for walk, at, type_, stream, payload in frames if type_ == DATA and (found := self.wanted(walk, stream, payload))), self.arrow)
                return
            rows: list[tuple] = []
            for walk, at, type_, stream, payload in frames:
                rows += self.rows(part.file, walk, at, type_, stream, payload)
                if len(rows) >= 8192:
                    yield self.batch(rows)
                    rows = []
            if rows:
                yield self.batch(rows)

    def intact(self, file, part: Split) -> Iterator[tuple[Walk, int, int | None, int, bytes]]:
        """The frames of the segments that begin in each range of the split. Where one is torn or damaged, a frame of type None, and on from the
        next intact SYNC; one beyond the range is the next range's, so that the same frames come out however a file is split."""
        for start in range(part.start, part.end, part.step):
            end = min(start + part.step, part.end)
            begin = next_sync(file, part.size, start, end)
            if begin is not None:
                walk = Walk(file, part.size, begin)
                yield from ((walk, *x) for x in self.segments(walk, end))

    def segments(self, walk: Walk, end: int) -> Iterator[tuple[int, int | None, int, bytes]]:
        while True:
            for at, type_, stream, payload in walk.frames():
                if type_ == SYNC and at >= end:
                    return
                yield at, type_, stream, payload
            if walk.at < walk.size:
                yield walk.at, None, 0, b""
            if not walk.resume(end):
                return

    def wanted(self, walk: Walk, stream: int, payload: bytes) -> tuple | None:
        """(schema, split frame) of a DATA frame of the stream and window asked for; None if it can't be read."""
        schema = walk.schemas.get(stream)
        if not schema or self.stream and self.stream not in (schema.uuid, schema.name) or outside(schema, payload, self.window):
            return None
        if self.equal and self.ruled_out(segment=walk.segment, stream=schema.uuid, run_id=struct.unpack("<I", payload[12:16])[0]):
            return None
        try:
            return schema, split_data(schema, payload)
        except (ValueError, struct.error):
            return None

    def records(self, file: str, walk: Walk, at: int, stream: int, payload: bytes) -> pa.RecordBatch | None:
        """The records of a frame as columns, without a Python object per record."""
        found = self.wanted(walk, stream, payload)
        if not found or not found[1][2]:
            return None
        return record_batch([(file, walk.segment, at, *found, 0)], self.arrow)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.arrow)], schema=self.arrow)

    def rows(self, file: str, walk: Walk, at: int, type_: int, stream: int, payload: bytes) -> list[tuple]:
        place = (file, walk.segment)
        if type_ is None:
            return [(*place, at, "damaged", None, None, None, None, None, 0, "torn or damaged, up to the next intact segment")] if self.view == "frames" else []
        schema = walk.schemas.get(stream)
        if self.view == "stats":
            found = self.wanted(walk, stream, payload) if type_ == DATA else None
            if not found:
                return []
            schema, (base, run, n, fixed, tails) = found
            tick, value = (base, None) if schema.timed else (None, base)
            matrix = np.frombuffer(fixed, np.uint8).reshape(n, schema.record_bytes)
            return [(*place, at, schema.uuid, run, n, tick, value, *x) for x in arrays.statistics(schema, matrix, tails)]
        if self.view == "index":
            found = self.wanted(walk, stream, payload) if type_ == DATA else None
            if not found:
                return []
            schema, (base, run, n, fixed, tails) = found
            tick, value = (base, None) if schema.timed else (None, base)
            matrix = np.frombuffer(fixed, np.uint8).reshape(n, schema.record_bytes)
            kept = [dict(zip(("field", "n_present", "low", "high", "first_value", "last_value", "several"), x)) for x in arrays.statistics(schema, matrix, tails)]
            return [(file, walk.segment, walk.sync, at, 12 + len(payload), schema.uuid, walk.layouts[stream], run, n, tick, value, *extent(schema, base, n, fixed), kept)]
        if self.view == "frames":
            run = count = tick = value = None
            why = None if type_ in NAMES else f"frame type 0x{type_:02x}"
            if type_ == SCHEMA:
                why = walk.bad.get(stream)
            if type_ == DATA:
                count, run, codec_, filter_ = struct.unpack("<IIBB", payload[8:18])
                why = walk.bad.get(stream) or ("unbound stream" if not schema else "codec" if codec_ not in (codec.NONE, codec.ZSTD, codec.DEFLATE) else "filter" if filter_ > 1 else None)
                if schema:
                    base = struct.unpack("<q" if schema.timed else "<d", payload[:8])[0]
                    tick, value = (base, None) if schema.timed else (None, base)
            return [(*place, at, NAMES.get(type_, f"0x{type_:02x}"), schema.uuid if schema and type_ in (DATA, SCHEMA) else None, run, count, tick, value, len(payload), why)]
        if self.view == "streams" and type_ == SCHEMA and schema:
            return [(*place, schema.uuid, schema.name, schema.record_bits, len(schema.fields), schema.axis_kind, schema.axis_mode, schema.axis_exp, schema.axis_unit, payload)]
        b = Bytes(payload)
        if self.view == "runs" and type_ == RUN:
            return [(*place, b.get("I"), b.get("I"), [*dict(b.pairs()).items()])]
        if self.view == "meta" and type_ == META:
            return [(*place, at, b.text(), b.text())]
        if self.view == "attachments" and type_ == ATTACH:
            return [(*place, at, b.text(), b.take(b.get("I")))]
        return []


def record_batch(frames: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    """The records of frames (file, segment, place, schema, split frame, number of its first record) as columns of the `records` view."""
    files, segments, places, schemas, found, firsts = zip(*frames)
    bases, runs, counts, fixed, tails = zip(*found)
    n, of = sum(counts), pa.array(np.repeat(np.arange(len(frames)), counts))
    each = lambda values, kind: pa.repeat(pa.scalar(values[0], kind), n) if len(frames) == 1 else pa.array(values, kind).take(of)
    widths = np.repeat([s.record_bytes for s in schemas], counts)
    ticks = [b if s.timed else None for b, s in zip(bases, schemas)]
    values = [None if s.timed else b for b, s in zip(bases, schemas)]
    blobs = pa.array([row for own, k in zip(tails, counts) for row in own or [None] * k], pa.list_(pa.binary())) if any(tails) else pa.nulls(n, pa.list_(pa.binary()))
    index = pa.array(np.concatenate([np.arange(first, first + k, dtype=np.int32) for first, k in zip(firsts, counts)]))
    columns = [each(files, pa.string()), each(segments, pa.int64()), each(places, pa.int64()), index, each([s.uuid for s in schemas], pa.string()), each(runs, pa.int64()), each(ticks, pa.int64()), each(values, pa.float64()), binary_array(widths, b"".join(fixed)), blobs]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def binary_array(widths: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    """Values of these widths that lie end to end."""
    ends = np.zeros(len(widths) + 1, np.int32)
    np.cumsum(widths, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(widths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def record_batches(frames: Iterable[tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Small frames share a batch, large ones are cut, so that a reader holds few records as columns."""
    held: list[tuple] = []
    records = size = 0
    for file, segment, place, schema, (base, run, n, fixed, tails) in frames:
        for first in range(0, n, BATCH_RECORDS):
            count, width = min(BATCH_RECORDS, n - first), schema.record_bytes
            part, blobs = fixed[first * width : (first + count) * width], tails[first : first + count] if tails else None
            own = len(part) + sum(len(x) for row in blobs or [] for x in row)
            if held and (records + count > BATCH_RECORDS or size + own > BATCH_BYTES):
                yield record_batch(held, arrow)
                held, records, size = [], 0, 0
            held.append((file, segment, place, schema, (base, run, count, part, blobs), first))
            records, size = records + count, size + own
    if held:
        yield record_batch(held, arrow)


def schema_at(file: str, sync: int, frame_offset: int) -> Schema:
    """The schema that binds the DATA frame at frame_offset, in the segment that begins at sync."""
    store, path = open_store(file)
    with store.open_input_file(path) as opened:
        walk = Walk(opened, opened.size(), sync)
        for at, _, stream, _ in walk.frames():
            if at == frame_offset and stream in walk.schemas:
                return walk.schemas[stream]
    raise SchemaError(f"{file}: no frame at {frame_offset} as the index has it")


def records_at(frames: DataFrame, schema: Schema) -> DataFrame:
    """The records of frames of one stream, given by rows of the `index` view; each is read by its place, nothing between. A frame that isn't
    as the index has it is an error, as its records would be missing."""
    definition, view = put_schema(schema), VIEWS["records"]
    arrow = pa.schema([(x.split()[0], _arrow(x.split()[1].replace("long", "bigint"))) for x in view.split(", ")])

    def split_frames(places: Iterable[tuple]) -> Iterator[tuple]:
        own = parse_schema(definition)
        opened, name = None, None
        try:
            for file, at, size, segment in places:
                if file != name:
                    if opened:
                        opened.close()
                    store, path = open_store(file)
                    opened, name = store.open_input_file(path), file
                raw = opened.read_at(size, at)
                if len(raw) < size or struct.unpack("<I", raw[-4:])[0] != codec.crc32c(raw[:-4]):
                    raise ValueError(f"{file}: the frame at {at} isn't as the index has it")
                yield file, segment, at, own, split_data(own, raw[8:-4])
        finally:
            if opened:
                opened.close()

    def read_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from record_batches(split_frames(sorted(zip(*(c.to_pylist() for c in batch.columns)))), arrow)

    return frames.where(F.col("stream") == schema.uuid).select("file", "frame_offset", "frame_bytes", "segment").mapInArrow(read_frames, view)


def _arrow(name: str) -> pa.DataType:
    if name.startswith("array<struct<"):
        return pa.list_(pa.struct([(k, _arrow(v)) for k, v in (x.split(":") for x in name[13:-2].split(","))]))
    plain = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return plain[name]


class PartFile(WriterCommitMessage):
    def __init__(self, name: str, records: int):
        self.name, self.records = name, records


def joined(column: pa.ChunkedArray) -> bytes:
    """The values of a binary column end to end, without an object for each."""
    if column.null_count:
        raise ValueError("a record is absent")
    parts = []
    for chunk in column.cast(pa.large_binary()).chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else [0, 0]
        parts.append(bytes(memoryview(chunk.buffers()[2] or b"")[ends[0] : ends[-1]]))
    return b"".join(parts)


class RecordingWriter(DataSourceArrowWriter):
    """One container file per task, of one segment per option segmentFrames frames. Rows come sorted by run and axis, with records or, by option
    raw, with the raw values of the fields, which are packed here: a task has one Python worker then, not another one for the records."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.schema = parse_schema(bytes.fromhex(options["schema"]))
        self.meta, self.attached = json.loads(options.get("meta", "[]")), json.loads(options.get("attachments", "[]"))
        self.raw = options.get("raw", "false") == "true"
        self.codec, self.frame_records, self.segment_frames = int(options.get("codec", codec.ZSTD)), int(options.get("framerecords", 65_536)), int(options.get("segmentframes", 64))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartFile:
        store, folder = open_store(self.path)
        store.create_dir(folder, recursive=True)
        name, n, frames, segments = f"part-{uuid.uuid4().hex}.rec", 0, 0, 0
        restated, variable = frame(SCHEMA, put_schema(self.schema), 1), any(f.variable for f in self.schema.fields)
        with store.open_output_stream(f"{folder}/.{name}", compression=None) as out:
            out.write(header())
            for part in self.frames(map(self.packed, iterator) if self.raw else iterator):
                if not frames % self.segment_frames:
                    out.write(sync(segments, 0) + restated)
                    if not segments:
                        out.write(b"".join(frame(META, put_text(k) + put_text(v)) for k, v in self.meta))
                        out.write(b"".join(frame(ATTACH, put_text(k) + struct.pack("<I", len(v) // 2) + bytes.fromhex(v)) for k, v in self.attached))
                    segments += 1
                tails = [[*map(bytes, x)] for x in part["tails"].to_pylist()] if variable else None
                out.write(data_frame(self.schema, 1, part["axis"][0].as_py(), joined(part["record"]), tails, part["run_id"][0].as_py() or 0, self.codec))
                frames, n = frames + 1, n + part.num_rows
            out.write(frame(END, b""))
        return PartFile(name, n)

    def packed(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """A batch of axis, run_id and the fields as one of axis, run_id, record and tails."""
        columns = batch.columns[2:]
        blobs = [c.to_pylist() for f, c in zip(self.schema.fields, columns) if f.variable]
        tails = pa.array([list(x) for x in zip(*blobs)], pa.list_(pa.binary())) if blobs else pa.nulls(batch.num_rows, pa.list_(pa.binary()))
        fixed = [(f, c) for f, c in zip(self.schema.fields, columns) if not f.variable]
        matrix = arrays.packed(*zip(*fixed), self.schema.record_bytes) if fixed else np.zeros((batch.num_rows, self.schema.record_bytes), np.uint8)
        record = binary_array(np.full(batch.num_rows, self.schema.record_bytes), matrix.reshape(-1))
        return pa.RecordBatch.from_arrays([batch["axis"], batch["run_id"], record, tails], names=["axis", "run_id", "record", "tails"])

    def frames(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of one run, frame_records at most."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            runs = batch["run_id"].fill_null(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            for a, b in zip(cuts, cuts[1:]):
                if held and (held[-1]["run_id"][0].as_py() or 0) != runs[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                while a < b:
                    room = self.frame_records - sum(x.num_rows for x in held)
                    held.append(batch.slice(a, min(room, b - a)))
                    a += held[-1].num_rows
                    if sum(x.num_rows for x in held) == self.frame_records:
                        yield pa.Table.from_batches(held)
                        held = []
        if held:
            yield pa.Table.from_batches(held)

    def commit(self, messages) -> None:
        """Gives the files of the attempts that count their names; those of others stay hidden, and hidden files are never read."""
        store, folder = open_store(self.path)
        for m in messages:
            store.move(f"{folder}/.{m.name}", f"{folder}/{m.name}")

    def abort(self, messages) -> None:
        store, folder = open_store(self.path)
        for m in filter(None, messages):
            store.delete_file(f"{folder}/.{m.name}")


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return VIEWS[self.options.get("view", "records")]

    def reader(self, schema) -> RecordingReader:
        return RecordingReader({k.lower(): v for k, v in self.options.items()}, schema)

    def writer(self, schema, overwrite: bool) -> RecordingWriter:
        return RecordingWriter({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, view: str = "records", **options) -> DataFrame:
    spark.dataSource.register(Recordings)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters, which Spark refuses without this
    return spark.read.format("recording").option("view", view).options(**options).load(path)


def write(rows: DataFrame, path: str, schema: Schema, **options) -> None:
    """rows (axis, run_id, record, tails): sorted within each partition by run and axis. Options: codec, frameRecords, segmentFrames,
    meta (JSON pairs) and attachments (JSON pairs of name and hexadecimal data), which the first segment of each file gets."""
    rows.sparkSession.dataSource.register(Recordings)
    ready = rows.select("axis", "run_id", "record", "tails").sortWithinPartitions("run_id", "axis")
    ready.write.format("recording").option("schema", put_schema(schema.validate()).hex()).options(**options).mode("append").save(path)


def write_values(rows: DataFrame, path: str, schema: Schema, **options) -> None:
    """As write(encode(rows, schema), ...), for rows of axis, run_id and the raw value of each field; the writer packs the records itself."""
    rows.sparkSession.dataSource.register(Recordings)
    value = lambda f: F.coalesce(F.col(f.name).cast("binary"), F.lit(b"")) if f.variable else F.col(f.name)
    ready = rows.select("axis", "run_id", *[value(f).alias(f"f{i}") for i, f in enumerate(schema.fields)]).sortWithinPartitions("run_id", "axis")
    ready.write.format("recording").option("schema", put_schema(schema.validate()).hex()).option("raw", "true").options(**options).mode("append").save(path)


def stream_schema(spark: SparkSession, path: str, stream: str | None = None) -> Schema:
    """The first binding of a stream. All bindings must agree."""
    rows = read(spark, path, "streams")
    rows = rows.where((F.col("stream") == stream) | (F.col("name") == stream)) if stream else rows
    found = rows.groupBy("stream", "schema").agg(F.min(F.struct("file", "segment")).alias("at")).orderBy("at").limit(2).collect()
    if not found:
        raise SchemaError("no such stream")
    if len(found) > 1 and found[0].stream == found[1].stream:
        raise SchemaError(f"{found[0].stream}: restated with another layout")
    return parse_schema(bytes(found[0].schema))


def ieee(raw: Column, width: int) -> Column:
    """The double that a pattern of 16, 32 or 64 bits stands for; every step is exact."""
    fraction, span, bias = {16: (10, 5, 15), 32: (23, 8, 127), 64: (52, 11, 1023)}[width]
    mantissa = raw.bitwiseAND(F.lit((1 << fraction) - 1))
    exponent = F.shiftrightunsigned(raw, fraction).bitwiseAND(F.lit((1 << span) - 1))
    sign = F.when(F.shiftrightunsigned(raw, width - 1).bitwiseAND(F.lit(1)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    size = F.when(exponent == 0, mantissa).otherwise(mantissa + F.lit(1 << fraction)).cast("double")
    power = F.greatest(exponent, F.lit(1)) - F.lit(bias + fraction)
    special = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == (1 << span) - 1, special).otherwise(size * F.pow(F.lit(2.0), power))


def raw_column(f: Field, record: Column, tails: Column, slot: int | None) -> Column:
    if f.variable or f.type in ("bytes", "string"):
        blob = F.get(tails, F.lit(slot)) if f.variable else F.substring(record, f.offset // 8 + 1, f.width // 8)
        return F.regexp_replace(F.make_valid_utf8(blob.cast("string")), r"\x00+\z", "") if f.type == "string" else blob
    if f.type == "complex":
        half = f.width // 2
        parts = [bits.bit_slice(record, f.offset + k * half, half, f.big_endian) for k in (0, 1)]
        return F.struct(ieee(parts[0], half).alias("re"), ieee(parts[1], half).alias("im"))
    raw = bits.bit_slice(record, f.offset, 1 if f.type == "bool" else f.width, f.big_endian)
    if f.type == "float":
        return ieee(raw, f.width)
    if f.type == "bool":
        return raw == 1
    return bits.sign_extend(raw, f.width) if f.type == "sint" else bits.unsigned64(raw) if f.width == 64 else raw


def value_column(schema: Schema, i: int) -> Column:
    """The physical value of field i: raw bits, conversion, and absence where the guard isn't met."""
    from ..functions import conversions

    f, record, tails = schema.fields[i], F.col("record"), F.col("tails")
    slot = sum(x.variable for x in schema.fields[:i]) if f.variable else None
    value = raw_column(f, record, tails, slot)
    if f.conversion.kind != "identity":
        if f.type == "complex":
            value = conversions.complex_linear(value, *f.conversion.params) if f.conversion.kind == "linear" else conversions.complex_rational(value, f.conversion.params)
        else:
            value = f.conversion.column(conversions.numeric(value, f.type))
    if f.type == "float" and f.conversion.kind not in ("value_to_text", "range_to_text"):
        value = conversions.finite(value)
    if f.guard:
        g = schema.fields[f.guard[0]]
        wanted = f.guard[1] - (1 << 64) if f.guard[1] >> 63 else f.guard[1]
        value = bits.guarded(value, bits.bit_slice(record, g.offset, g.width, g.big_endian), wanted)
    return value


def axis_column(schema: Schema) -> Column:
    base = F.col("axis_tick") if schema.timed else F.col("axis_value")
    if schema.axis_mode == "explicit":
        raw = raw_column(schema.fields[schema.axis_field], F.col("record"), F.col("tails"), None)
        return axes.explicit_axis(base, raw.cast("long" if schema.timed else "double"), schema.axis_scale)
    if schema.axis_mode == "log":
        return axes.log_axis(base, F.col("rec_idx"), schema.axis_step)
    return axes.implicit_axis(base, F.col("rec_idx"), schema.axis_step)


def decode(records: DataFrame, schema: Schema) -> DataFrame:
    """Records of one stream as columns: place, run, axis and a column per field."""
    own = records.where(F.col("stream") == schema.uuid)
    fields = [value_column(schema, i).alias(f.name, metadata={"unit": f.unit, "desc": f.desc}) for i, f in enumerate(schema.fields)]
    return own.select("file", "segment", "frame_offset", "rec_idx", "run_id", axis_column(schema).alias("axis"), *fields)


def encode(rows: DataFrame, schema: Schema) -> DataFrame:
    """The inverse for fields given as raw values: adds `record` and `tails`. An absent float is no number, which decodes as absent; other absent values are zeros."""
    fixed = [f for f in schema.fields if not f.variable]
    names = [f.name for f in fixed]

    @F.arrow_udf("binary")
    def packed(*columns: pa.Array) -> pa.Array:
        return binary_array(np.full(len(columns[0]), schema.record_bytes), arrays.packed(fixed, columns, schema.record_bytes).reshape(-1))

    tails = F.array(*[F.coalesce(F.col(f.name).cast("binary"), F.lit(b"")) for f in schema.fields if f.variable]) if any(f.variable for f in schema.fields) else F.lit(None).cast("array<binary>")
    return rows.withColumn("record", packed(*[F.col(c) for c in names]) if names else F.lit(b"")).withColumn("tails", tails)

"""MDF4 measurement files as canonical records.

The driver walks the block graph and turns each channel group into a Schema; records stay binary and are decoded by the same
Catalyst expressions as those of containers. Tasks read data blocks: a sorted group's blocks are split by whole records, an
unsorted data group, whose record lengths vary, is read by one task in order. Variable-length signal data is inlined as tails.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import Conversion, Field, Schema
from .container import VIEWS, decode, list_files, open_store

#: Fixed values of the format: channel and conversion kinds, encodings of text by data type.
VLSD_CHANNEL, MASTER, VIRTUAL_MASTER, VIRTUAL = 1, 2, 3, 6
ENCODINGS = {6: "latin-1", 7: "utf-8", 8: "utf-16-le", 9: "utf-16-be"}


class MdfError(ValueError):
    """A file that isn't MDF 4 or a block that isn't what its link promises."""


@dataclass
class Channel:
    name: str
    kind: int
    sync: int
    data_type: int
    offset: int
    width: int
    unit: str
    desc: str
    conversion: Conversion
    data: int
    invalidation: int | None

    @property
    def carried(self) -> bool:
        """Whether values come as tails of records: of varying length, or texts that aren't in UTF-8."""
        return self.kind == VLSD_CHANNEL or self.data_type in ENCODINGS and self.data_type != 7 and self.kind not in (VIRTUAL, VIRTUAL_MASTER)


@dataclass
class Group:
    name: str
    record_id: int
    id_bytes: int
    cycles: int
    data_bytes: int
    invalid_bytes: int
    data: int
    channels: list[Channel] = field(default_factory=list)
    vlsd: bool = False
    siblings: dict[int, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


class Blocks:
    def __init__(self, file):
        self.file, self.size = file, file.size()

    def block(self, at: int, want: str | None = None) -> tuple[str, list[int], bytes]:
        """(id, links, data)"""
        head = self.file.read_at(24, at)
        if len(head) < 24 or head[:2] != b"##":
            raise MdfError(f"no block at {at}")
        kind = head[2:4].decode("latin-1")
        length, n = struct.unpack("<QQ", head[8:])
        if want and kind not in want.split():
            raise MdfError(f"{kind} block at {at} where {want} is linked")
        if length < 24 + 8 * n or at + length > self.size:
            raise MdfError(f"the block at {at} exceeds the file")
        body = self.file.read_at(length - 24, at + 24)
        return kind, list(struct.unpack(f"<{n}q", body[: 8 * n])), body[8 * n :]

    def text(self, at: int) -> str:
        if not at:
            return ""
        kind, _, data = self.block(at)
        raw = data.split(b"\0")[0].decode("utf-8", "replace")
        if kind == "MD":
            start, end = raw.find("<TX>"), raw.find("</TX>")
            return raw[start + 4 : end] if 0 <= start < end else raw
        return raw

    def chain(self, at: int, want: str) -> Iterator[tuple[int, list[int], bytes]]:
        seen = set()
        while at:
            if at in seen:
                raise MdfError("blocks are linked in a circle")
            seen.add(at)
            _, links, data = self.block(at, want)
            yield at, links, data
            at = links[0]

    def parts(self, at: int) -> list[tuple[int, int, str]]:
        """(place of the block, bytes of data, kind) of the data blocks in turn."""
        if not at:
            return []
        head = self.file.read_at(24, at)
        kind, length = head[2:4].decode("latin-1"), struct.unpack("<Q", head[8:16])[0]
        if kind in ("DT", "SD", "RD", "DV"):
            return [(at, length - 24, kind)]
        if kind == "DZ":
            info = self.file.read_at(24, at + 24)
            return [(at, struct.unpack("<Q", info[8:16])[0], kind)]
        if kind == "HL":
            return self.parts(self.block(at)[1][0])
        if kind == "DL":
            return [p for _, links, _ in self.chain(at, "DL") for x in links[1:] for p in self.parts(x)]
        raise MdfError(f"{kind} block at {at} where data is linked")

    def data(self, part: tuple[int, int, str]) -> bytes:
        at, size, kind = part
        if kind != "DZ":
            return self.file.read_at(size, at + 24)
        head = self.file.read_at(24, at + 24)
        _, how, _, columns, whole, packed = struct.unpack("<2sBBIQQ", head)
        raw = zlib.decompress(self.file.read_at(packed, at + 48))
        if len(raw) != whole or how > 1:
            raise MdfError("a packed block differs from its header")
        if how == 1 and columns:
            n = whole // columns
            raw = np.frombuffer(raw[: n * columns], np.uint8).reshape(columns, n).T.tobytes() + raw[n * columns :]
        return raw


def conversion_of(blocks: Blocks, at: int, warnings: list[str], name: str) -> Conversion:
    if not at:
        return Conversion()
    _, links, data = blocks.block(at, "CC")
    kind, _, _, refs, n = struct.unpack("<BBHHH", data[:8])
    values, texts = struct.unpack(f"<{n}d", data[24 : 24 + 8 * n]), links[4 : 4 + refs]
    label = lambda x: "" if not x or blocks.file.read_at(4, x) == b"##CC" else blocks.text(x)
    if kind == 1:
        return Conversion("linear", values[:2])
    if kind == 2:
        return Conversion("rational", values[:6])
    if kind == 4:
        return Conversion("table_interp", (values[::2], values[1::2]))
    if kind == 5:
        from ..functions.conversions import nearest_table

        keys, vals = nearest_table(values[::2], values[1::2])
        return Conversion("table", (tuple(keys), tuple(vals)))
    if kind == 7:
        return Conversion("value_to_text", (tuple((v, label(t)) for v, t in zip(values, texts)), label(texts[-1]) if len(texts) > n else ""))
    if kind == 8:
        return Conversion("range_to_text", (tuple((a, b, label(t)) for a, b, t in zip(values[::2], values[1::2], texts)), label(texts[-1]) if len(texts) > n // 2 else ""))
    if kind:
        warnings.append(f"{name}: conversion {kind} is not applied, raw values stay")
    return Conversion()


def read_groups(path: str) -> list[Group]:
    store, inner = open_store(path)
    with store.open_input_file(inner) as file:
        head = file.read_at(64, 0)
        if head[:8] not in (b"MDF     ", b"UnFinMF ") or struct.unpack("<H", head[28:30])[0] < 400:
            raise MdfError("not an MDF 4 file")
        blocks, groups = Blocks(file), []
        _, links, _ = blocks.block(64, "HD")
        for _, dg, dg_data in blocks.chain(links[0], "DG"):
            own = []
            for number, (_, cg, data) in enumerate(blocks.chain(dg[1], "CG")):
                record_id, cycles, flags, _, _, data_bytes, invalid_bytes = struct.unpack("<QQHHIII", data[:32])
                group = Group(blocks.text(cg[2]) or f"group {len(groups) + number}", record_id, dg_data[0], cycles, data_bytes, invalid_bytes, dg[2], vlsd=bool(flags & 1))
                for _, cn, info in blocks.chain(cg[1], "CN"):
                    kind, sync, type_, bit, byte, width, flags_, invalid = struct.unpack("<BBBBIIII", info[:20])
                    name = blocks.text(cn[2])
                    group.channels.append(Channel(name, kind, sync, type_, 8 * byte + bit, width, blocks.text(cn[6]), blocks.text(cn[7]), conversion_of(blocks, cn[4], group.warnings, name), cn[5], invalid if flags_ & 2 else None))
                own.append(group)
            sizes = {g.record_id: -1 if g.vlsd else g.data_bytes + g.invalid_bytes for g in own}
            for g in own:
                g.siblings = sizes
            groups += [g for g in own if not g.vlsd]
        return groups


def attachments(path: str) -> list[tuple[str, bytes | None]]:
    """(name, data) of embedded files, deflated or not; None for files that are only named."""
    store, inner = open_store(path)
    with store.open_input_file(inner) as file:
        blocks, out = Blocks(file), []
        _, links, _ = blocks.block(64, "HD")
        for _, at, data in blocks.chain(links[3], "AT"):
            flags, _, _, _, whole, size = struct.unpack("<HHI16sQQ", data[:40])
            body = data[40 : 40 + size] if flags & 1 else None
            if body is not None and flags & 2:
                body = zlib.decompress(body)
                if len(body) != whole:
                    raise MdfError("an attachment differs from its header")
            out.append((blocks.text(at[1]), body))
        return out


def group_schema(group: Group, path: str) -> Schema:
    """Fields in channel order; invalidation bits become guards. The master is the explicit axis; without one records are counted."""
    fields, guards = [], {}
    master = None
    for c in group.channels:
        blob = c.data_type in (6, 7, 8, 9, 10) or c.kind == VLSD_CHANNEL
        kind = "bytes" if c.data_type == 10 else "string" if blob else {0: "uint", 1: "uint", 2: "sint", 3: "sint", 4: "float", 5: "float"}.get(c.data_type)
        if kind is None or c.kind in (VIRTUAL, VIRTUAL_MASTER):
            group.warnings.append(f"{c.name}: data type {c.data_type}, channel type {c.kind} is left out")
            continue
        big = c.data_type in (1, 3, 5)
        offset = c.offset
        if big:
            if c.offset % 8 or c.width % 8:
                group.warnings.append(f"{c.name}: unaligned big-endian bits are left out")
                continue
        if c.kind == MASTER:
            master = len(fields)
        fields.append(Field(c.name, 0 if c.carried else offset, 0 if c.carried else c.width, kind, big, c.carried, None, Conversion() if blob else c.conversion, c.unit, c.desc))
        if c.invalidation is not None:
            guards[len(fields) - 1] = 8 * group.data_bytes + c.invalidation
    for i, bit in guards.items():
        fields.append(Field(f"{fields[i].name} invalid", bit, 1))
        f = fields[i]
        fields[i] = Field(f.name, f.offset, f.width, f.type, f.big_endian, f.variable, (len(fields) - 1, 0), f.conversion, f.unit, f.desc)
    bits = 8 * (group.data_bytes + group.invalid_bytes)
    identity = str(uuid.uuid5(uuid.NAMESPACE_OID, f"mdf4:{group.name}:{','.join(f.name for f in fields)}"))
    if master is None:
        return Schema(identity, group.name, bits, tuple(fields), "index", "implicit", 0, "", 1.0, 1.0).validate()
    return Schema(identity, group.name, bits, tuple(fields), "other", "explicit", 0, fields[master].unit, 1.0, 1.0, master).validate()


def groups_of(path: str) -> list[Group]:
    """The groups of a file, or of the first file of a folder."""
    files = list_files(path)
    if not files:
        raise MdfError(f"{path}: no file")
    return read_groups(files[0][0])


class Span(InputPartition):
    def __init__(self, file: str, first: int, skip: int, parts: list[tuple[int, int, str]], base: int):
        self.file, self.first, self.skip, self.parts, self.base = file, first, skip, parts, base


class MdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.name = [p for p, _ in list_files(options["path"])], options["group"]
        self.schema_ = self.of(self.files[0])[1]

    def of(self, path: str) -> tuple[Group | None, Schema | None]:
        group = next((g for g in read_groups(path) if g.name == self.name), None)
        return group, group and group_schema(group, path)

    def partitions(self) -> list[Span]:
        """Files without the group have no rows; one that has it with other fields is an error, as its records would be read wrongly."""
        out = []
        for path in self.files:
            group, schema = self.of(path)
            if group and schema.fields != self.schema_.fields:
                raise MdfError(f"{path}: {self.name} has other fields than in {self.files[0]}")
            out += self.spans(path, group) if group else []
        return out

    def spans(self, path: str, group: Group) -> list[Span]:
        """A span per data block of a sorted group, with the next blocks' parts that its last record needs; else one span."""
        store, inner = open_store(path)
        with store.open_input_file(inner) as file:
            parts = Blocks(file).parts(group.data)
        size = group.data_bytes + group.invalid_bytes
        if group.id_bytes or not size or len(parts) < 2:
            return [Span(path, 0, 0, parts, 0)]
        out, at = [], 0
        for k, (_, n, _) in enumerate(parts):
            first, end = -(-at // size), (at + n - 1) // size
            if first * size < at + n:
                last, have = k, at + n
                while have < (end + 1) * size and last + 1 < len(parts):
                    last += 1
                    have += parts[last][1]
                out.append(Span(path, first, first * size - at, parts[k : last + 1], end + 1 - first))
            at += n
        return out

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(span.file)
        group, _ = self.of(span.file)
        size = group.data_bytes + group.invalid_bytes
        with store.open_input_file(inner) as file:
            blocks = Blocks(file)
            variable = [c for c in group.channels if c.carried]
            signal, number_of = {}, {}
            for c in variable:
                if c.kind == VLSD_CHANNEL and c.data and file.read_at(4, c.data) == b"##CG":
                    number_of[id(c)] = struct.unpack("<Q", blocks.block(c.data)[2][:8])[0]
                elif c.kind == VLSD_CHANNEL:
                    signal[id(c)] = b"".join(map(blocks.data, blocks.parts(c.data)))
            data = b"".join(map(blocks.data, span.parts))[span.skip :]
            if group.id_bytes:
                records, inline = demux(data, group)
            else:
                most = span.base or len(data) // size if size else 0
                records, inline = [data[i * size : (i + 1) * size] for i in range(most) if (i + 1) * size <= len(data)], {}
            if not span.base:
                records = records[: group.cycles] if group.cycles else records
            for at in range(0, len(records), 8192):
                some = records[at : at + 8192]
                tails = [[tail_of(r, c, signal.get(id(c), inline.get(number_of.get(id(c)), b""))) for c in variable] for r in some] if variable else [None] * len(some)
                n = len(some)
                number = [span.first + at + i for i in range(n)]
                columns = [[span.file] * n, [0] * n, [0] * n, number, [self.schema_.uuid] * n, [0] * n, [None] * n, [0.0] * n, some, tails]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in VIEWS["records"].split(", ")])


def demux(data: bytes, group: Group) -> tuple[list[bytes], dict[int, bytes]]:
    """(the group's records, by record id the bytes of variable-length records with their lengths) of an unsorted data group, in order."""
    at, records, inline = 0, [], {}
    while at + group.id_bytes <= len(data):
        record_id = int.from_bytes(data[at : at + group.id_bytes], "little")
        at += group.id_bytes
        size = group.siblings.get(record_id)
        if size is None:
            raise MdfError(f"unknown record id {record_id}")
        if size < 0:
            n = 4 + int.from_bytes(data[at : at + 4], "little")
            inline.setdefault(record_id, []).append(data[at : at + n])
            at += n
            continue
        if at + size > len(data):
            break
        if record_id == group.record_id:
            records.append(data[at : at + size])
        at += size
    return records, {k: b"".join(x) for k, x in inline.items()}


def tail_of(record: bytes, c: Channel, signal: bytes) -> bytes:
    """The value of a channel that a record's tail carries: texts in UTF-8, up to the NULs at their end."""
    if c.kind == VLSD_CHANNEL:
        value = blob_at(signal, record, c)
    else:
        value = record[c.offset // 8 : (c.offset + c.width) // 8]
    if c.data_type not in ENCODINGS:
        return value
    return value.decode(ENCODINGS[c.data_type], "replace").rstrip("\0").encode("utf-8", "replace")


def blob_at(signal: bytes, record: bytes, c: Channel) -> bytes:
    """The length-framed bytes at the offset that the record holds."""
    at = int.from_bytes(record[c.offset // 8 : (c.offset + c.width + 7) // 8], "little")
    n = int.from_bytes(signal[at : at + 4], "little")
    return signal[at + 4 : at + 4 + n]


class Mdf4(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mdf4"

    def schema(self) -> str:
        return VIEWS["records"]

    def reader(self, schema) -> MdfReader:
        return MdfReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, group: str) -> tuple[DataFrame, list[str]]:
    """(the decoded channels of a group, warnings)"""
    spark.dataSource.register(Mdf4)
    own = next((g for g in groups_of(path) if g.name == group), None)
    if own is None:
        raise MdfError(f"no group {group}")
    schema = group_schema(own, path)
    return decode(spark.read.format("mdf4").option("group", group).load(path), schema), own.warnings

"""Containers: round trips, splits, torn tails, validation, and foreign files."""

import os
import struct
import subprocess
import sys
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.model import Conversion, Field, Schema, SchemaError
from tidemark.sources import codec, container, dbc, spice

ENGINE = Schema(str(uuid.uuid5(uuid.NAMESPACE_OID, "engine")), "engine", 40, (
    Field("mode", 0, 8, conversion=Conversion("value_to_text", (((0.0, "idle"), (2.0, "boost")), "?"))), Field("boost", 8, 16, guard=(0, 2), conversion=Conversion("linear", (0.0, 0.1)), unit="bar"),
    Field("temp", 24, 12, "sint"), Field("fault", 36, 1, "bool"), Field("note", 0, 0, "string", variable=True)), axis_step=10, meta=(("source", "test"),))
SWEEP = Schema(str(uuid.uuid5(uuid.NAMESPACE_OID, "sweep")), "sweep", 32, (Field("gain", 0, 32, "float"),), "frequency", "log", 0, "Hz", 10 ** (1 / 50), 1.0)


def record(i):
    return (2 * (i // 10 % 2)).to_bytes(1) + struct.pack("<H", i) + ((i - 50) & 0xFFF | (i % 7 == 0) << 12).to_bytes(2, "little")


def build(segments=3, per=100, codec_=codec.ZSTD, transposed=True):
    out, i = [container.header()], 0
    for s in range(segments):
        out += [container.sync(s, 0), container.frame(container.SCHEMA, container.put_schema(ENGINE), 1), container.frame(container.SCHEMA, container.put_schema(SWEEP), 2), container.frame(container.RUN, struct.pack("<II", 5, 0) + container.put_pairs([("t", "25")]))]
        if not s:
            out += [container.frame(container.META, container.put_text("title") + container.put_text("x")), container.frame(container.ATTACH, container.put_text("a.dbc") + struct.pack("<I", 3) + b"abc"), container.frame(0x7F, b"later")]
        rows = range(i, i + per)
        out.append(container.data_frame(ENGINE, 1, 10 * i, [record(k) for k in rows], [[f"n{k}".encode()] for k in rows], 5, codec_, transposed))
        out.append(container.data_frame(SWEEP, 2, 10.0, [struct.pack("<f", k) for k in range(4)], None, 0, codec_, transposed))
        out.append(container.frame(container.DATA, b"\0" * 32, 9))
        i += per
    return b"".join([*out, container.frame(container.END, b"")])


def put(tmp_path, data, name="x.rec"):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_crc32c():
    assert codec.crc32c(b"123456789") == 0xE3069283
    slow = 0xFFFFFFFF
    data = bytes(np.random.default_rng(0).integers(0, 256, 3000, np.uint8))
    for b in data:
        slow = int(codec.TABLE[(slow ^ b) & 255]) ^ (slow >> 8)
    assert codec.crc32c(data) == slow ^ 0xFFFFFFFF


def test_schema_round_trip():
    assert container.parse_schema(container.put_schema(ENGINE)) == ENGINE and container.parse_schema(container.put_schema(SWEEP)) == SWEEP


@pytest.mark.parametrize("codec_", [codec.NONE, codec.ZSTD, codec.DEFLATE])
@pytest.mark.parametrize("transposed", [False, True])
def test_values(spark, tmp_path, codec_, transposed):
    path = put(tmp_path, build(codec_=codec_, transposed=transposed))
    schema = container.stream_schema(spark, path, "engine")
    assert schema == ENGINE
    rows = container.decode(container.read(spark, path), schema).orderBy("axis").collect()
    assert len(rows) == 300
    for i, r in enumerate(rows):
        boost = 2 * (i // 10 % 2) == 2
        assert (r.axis, r.run_id, r.mode, r.temp, r.fault, r.note) == (10 * i, 5, "boost" if boost else "idle", (i - 50 + 2048) % 4096 - 2048, i % 7 == 0, f"n{i}")
        assert r.boost == (pytest.approx(0.1 * i) if boost else None)
    sweep = container.decode(container.read(spark, path), container.stream_schema(spark, path, "sweep")).where("segment = 0").orderBy("axis").collect()
    assert [r.gain for r in sweep] == [0, 1, 2, 3] and [r.axis for r in sweep] == pytest.approx([10 * 10 ** (k / 50) for k in range(4)])


@pytest.mark.parametrize("split", [64, 997, 1 << 20])
def test_splits_read_each_record_once(spark, tmp_path, split):
    path = put(tmp_path, build(5, 20))
    rows = container.read(spark, path, splitBytes=split).where(F.col("stream") == ENGINE.uuid).collect()
    assert sorted((r.segment, r.rec_idx) for r in rows) == [(s, i) for s in range(5) for i in range(20)]


def test_other_views_report_what_is_skipped(spark, tmp_path):
    path = put(tmp_path, build(2, 5))
    frames = container.read(spark, path, "frames").collect()
    assert {(r.type, r.unsupported) for r in frames if r.unsupported} == {("0x7f", "frame type 0x7f"), ("DATA", "unbound stream")}
    assert sum(r["count"] or 0 for r in frames if r.stream == ENGINE.uuid) == 10
    assert [(r.key, r.value) for r in container.read(spark, path, "meta").collect()] == [("title", "x")]
    assert [(r.name, bytes(r.data)) for r in container.read(spark, path, "attachments").collect()] == [("a.dbc", b"abc")]
    assert {(r.run_id, r.params["t"]) for r in container.read(spark, path, "runs").collect()} == {(5, "25")}


def test_every_truncation_is_a_valid_prefix():
    import pyarrow as pa

    data = build(2, 6)
    full = [(a, t) for a, t, _, _ in container.Walk(pa.BufferReader(data), len(data), 16).frames()]
    for cut in range(16, len(data)):
        got = [(a, t) for a, t, _, _ in container.Walk(pa.BufferReader(data[:cut]), cut, 16).frames()]
        assert got == full[: len(got)] and (len(got) == len(full) or cut < (full[len(got) + 1][0] if len(got) + 1 < len(full) else len(data)))


def test_concatenated_files_merge_by_stream(spark, tmp_path):
    one, two = build(1, 4), build(1, 6)
    path = put(tmp_path, one[:-12] + two[16:])
    assert container.read(spark, path).where(F.col("stream") == ENGINE.uuid).count() == 10


@pytest.mark.parametrize("split", [64, 500, 1 << 20])
def test_a_damaged_frame_costs_its_segment_only_and_is_told(spark, tmp_path, split):
    data = bytearray(build(4, 50))
    path = put(tmp_path, bytes(data))
    at = container.read(spark, path, "frames").where("segment = 1 AND type = 'DATA'").agg(F.min("frame_offset")).first()[0]
    data[at + 40] ^= 1
    put(tmp_path, bytes(data))
    rows = container.read(spark, path, splitBytes=split).where(F.col("stream") == ENGINE.uuid).groupBy("segment").count().collect()
    assert {r.segment: r["count"] for r in rows} == {0: 50, 2: 50, 3: 50}
    assert [(r.segment, r.frame_offset) for r in container.read(spark, path, "frames", splitBytes=split).where("type = 'damaged'").collect()] == [(1, at)]


def test_files_of_attempts_that_died_are_not_read(tmp_path):
    """A job of its own with retries: the first attempt of a task dies after it has given its rows."""
    code = f"""
import os
from pyspark.sql import SparkSession
from tidemark.model import Field, Schema
from tidemark.sources import container
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
plain = Schema("{ENGINE.uuid}", "plain", 64, (Field("a", 0, 64),), axis_mode="implicit", axis_step=1)
def once(batches):
    for b in batches:
        yield b
    if not os.path.exists("{tmp_path}/died"):
        open("{tmp_path}/died", "w").close()
        os._exit(1)
rows = container.encode(spark.range(0, 1000, 1, 2).selectExpr("id AS axis", "0L AS run_id", "id AS a"), plain)
rows = rows.select("axis", "run_id", "record", "tails").sortWithinPartitions("axis")
container.write(rows.mapInArrow(once, rows.schema), "{tmp_path}/out", plain, frameRecords=10)
open("{tmp_path}/out/.part-half.rec", "wb").write(b"half a file")
print("ROWS", container.read(spark, "{tmp_path}/out").count(), container.read(spark, "{tmp_path}/out").select("file").distinct().count())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, env=os.environ)
    assert "ROWS 1000 2" in out.stdout, out.stderr[-2000:]


def test_bad_text_and_floats_that_are_no_numbers(spark, tmp_path):
    schema = Schema(ENGINE.uuid, "odd", 64, (Field("s", 0, 32, "string"), Field("x", 32, 32, "float")), axis_mode="implicit", axis_step=1)
    records = [b"AB\0\0" + struct.pack("<f", float("nan")), b"\xff\xfeAB" + struct.pack("<f", float("inf")), b"\xc3\xa9AB" + struct.pack("<f", 1.5)]
    put(tmp_path, container.header() + container.sync(0, 0) + container.frame(container.SCHEMA, container.put_schema(schema), 1) + container.data_frame(schema, 1, 0, records))
    rows = container.decode(container.read(spark, str(tmp_path)), schema).orderBy("axis").collect()
    assert [(r.s, r.x) for r in rows] == [("AB", None), ("\ufffd\ufffdAB", None), ("éAB", 1.5)]


def test_damaged_header(spark, tmp_path):
    path = put(tmp_path, b"\0" + build(1, 1)[1:])
    with pytest.raises(Exception, match="not a recording"):
        container.read(spark, path).count()


@pytest.mark.parametrize("bad", [
    {"axis_kind": "time", "axis_mode": "log", "axis_step": 2}, {"axis_kind": "frequency", "axis_mode": "log", "axis_step": 1.0}, {"fields": (Field("x", 0, 65),)}, {"fields": (Field("x", 4, 8, "bytes"),)},
    {"fields": (Field("x", 0, 8, guard=(0, 1)),)}, {"fields": (Field("x", 0, 8, guard=(3, 1)),)}, {"fields": (Field("x", 0, 8, "bytes", conversion=Conversion("linear", (0.0, 1.0))),)}, {"fields": (Field("x", 0, 8, variable=True),)}, {"fields": (Field("x", 30, 8),)},
])
def test_invalid_schemas(bad):
    with pytest.raises(SchemaError):
        Schema(**{"uuid": ENGINE.uuid, "name": "x", "record_bits": 32, "fields": (), **bad}).validate()


def test_written_files_read_back(spark, tmp_path):
    plain = Schema(ENGINE.uuid, "plain", 48, (Field("a", 0, 12, "sint"), Field("b", 19, 13, big_endian=True), Field("c", 32, 16, "float"), Field("s", 0, 0, "string", variable=True)), axis_mode="implicit", axis_step=1)
    rows = spark.range(0, 1000, 1, 3).selectExpr("id AS axis", "id % 2 AS run_id", "CAST(id - 500 AS INT) AS a", "id % 8192 AS b", "CAST(id AS DOUBLE) / 4 AS c", "concat('s', id) AS s")
    out = str(tmp_path / "out")
    container.write(container.encode(rows, plain), out, plain, frameRecords=1)
    got = container.decode(container.read(spark, out), container.stream_schema(spark, out)).select("axis", "run_id", "a", "b", "c", "s").orderBy("axis").collect()
    assert [tuple(r) for r in got] == [(i, i % 2, i - 500, i, i / 4, f"s{i}") for i in range(1000)]


DBC = '''VERSION ""
NS_ :
	CM_
	VAL_

BO_ 321 Pump: 8 Control
 SG_ Count : 7|8@0+ (1,0) [0|255] "" X
 SG_ Page M : 8|8@1+ (1,0) [0|255] "" X,Y
 SG_ Flow m7 : 31|16@0+ (0.5,0) [0|1] "l/min" X
 SG_ Depth m3 : 24|8@1- (1,-10) [0|1] "m" X
BO_ 2147484000 Valve: 4 X
 SG_ State : 0|8@1- (1E0,0) [0|1] "" X

BO_ 77 Empty: 0 X
BO_ 78 Nested: 8 X
 SG_ Inner m1M : 0|8@1+ (1,0) [0|1] "" X
BO_ 79 Several: 8 X
 SG_ One m1 : 0|8@1+ (1,0) [0|1] "" X
CM_ "all; of it";
CM_ BO_ 321 "SG_ in a text
of two lines";
CM_ SG_ 321 Flow "what runs through";
SG_MUL_VAL_ 79 One Page 1-1, 3-4;
VAL_ 2147484000 State -1 "shut" 1 "open" ;
'''


def test_dbc(spark):
    messages = dbc.parse(DBC)
    assert [(m.name, m.can_id, m.extended, len(m.signals)) for m in messages] == [("Pump", 321, False, 4), ("Valve", 352, True, 1), ("Empty", 77, False, 0)]
    assert messages[0].signals[2].offset == 24 and messages[0].signals[2].comment == "what runs through" and messages[0].comment == "SG_ in a text\nof two lines"
    schema = dbc.message_schema(messages[0], DBC.encode())
    assert schema.fields[2].guard == (1, 7) and schema.uuid == dbc.message_schema(messages[0], DBC.encode()).uuid
    frames = spark.createDataFrame([(1, 321, False, bytes([8, 7, 0, 0x1A, 0xF8, 0, 0, 0])), (2, 321, False, bytes([3, 3, 0, 90])), (3, 321, False, bytes([1, 7, 0, 1])), (4, 352, True, b"\xff"), (5, 352, False, b"\xff")], "n int, can_id long, extended boolean, payload binary")
    got = {(r.n, r.signal): (r.value, r.text) for r in dbc.decode_frames(frames, messages).collect()}
    assert got == {(1, "Count"): (8, None), (1, "Page"): (7, None), (1, "Flow"): (0x1AF8 / 2, None), (2, "Count"): (3, None), (2, "Page"): (3, None), (2, "Depth"): (80, None), (3, "Count"): (1, None), (3, "Page"): (7, None), (4, "State"): (-1, "shut")}
    assert [(r.can_id, r.frames) for r in dbc.unknown_frames(frames, messages).collect()] == [(352, 1)]
    for wrong in ('BO_ 1 A: 8 X\n SG_ S : 0|8@2+ (1,0) [0|1] "" X', 'BO_ 1 A 8 X', 'BO_ 1 A: 8 X\n SG_ S q : 0|8@1+ (1,0) [0|1] "" X'):
        with pytest.raises(dbc.DatabaseError):
            dbc.parse(wrong)


def raw_file(flags, points, wide=False, extra=""):
    head = f"Title: t\nPlotname: AC Analysis\nFlags: {flags}\nNo. Variables: 2\nNo. Points: {len(points)}\nOffset: 0.0\n{extra}Variables:\n\t0\tfrequency\tfrequency\n\t1\tV(out)\tvoltage\nBinary:\n"
    body = b"".join(struct.pack("<ddff", x, 0, y.real, y.imag) if "complex" in flags else struct.pack("<df", x, y) for x, y in points)
    return head.encode("utf-16-le" if wide else "latin-1") + body


@pytest.mark.parametrize("wide", [False, True])
def test_spice_stepped_complex(spark, tmp_path, wide):
    points = [(10.0 ** (k % 4), complex(k, -k)) for k in range(12)]
    path = put(tmp_path, raw_file("complex forward stepped", points, wide), "a.raw")
    rows = spice.read(spark, path, splitPoints=5).orderBy("point").collect()
    assert [(r.axis, r["V(out)"].re, r["V(out)"].im, r.run_no) for r in rows] == [(x, y.real, y.imag, k // 4) for k, (x, y) in enumerate(points)]


def test_spice_refusals(tmp_path):
    for flags in ("real compressed", "real fastaccess"):
        with pytest.raises(spice.RawError):
            spice.parse_header(raw_file(flags, []))
    with pytest.raises(spice.RawError):
        spice.parse_header(raw_file("real", []).replace(b"Binary:", b"Values:"))


def test_frame_statistics_agree_with_decoded_records(spark, tmp_path):
    path = put(tmp_path, build(2, 50))
    rows = container.decode(container.read(spark, path), ENGINE)
    want = rows.groupBy("segment").agg(F.min("boost").alias("low"), F.max("boost").alias("high"), F.count("boost").alias("n"), F.min("temp").alias("t"), F.count("note").alias("notes")).collect()
    got = {(r.segment, r.field): r for r in container.read(spark, path, "stats").where(F.col("stream") == ENGINE.uuid).collect()}
    for w in want:
        b = got[w.segment, "boost"]
        assert (b.n_present, b.low, b.high) == (w.n, pytest.approx(w.low), pytest.approx(w.high)) and b.several
        assert got[w.segment, "temp"].low == w.t and got[w.segment, "note"].n_present == w.notes and got[w.segment, "mode"].high == 2
    assert {r.field for r in container.read(spark, path, "stats", stream="sweep").collect()} == {"gain"}


def test_arrays_read_bits_as_expressions_do(spark):
    from tidemark.functions import bits
    from tidemark.sources import arrays

    rng = np.random.default_rng(7)
    matrix = rng.integers(0, 256, (20, 12), np.uint8)
    rows = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(matrix)], "i int, record binary")
    layouts = [(int(rng.integers(0, 96 - w)), w, bool(rng.integers(2))) for w in [1, 7, 8, 12, 31, 33, 57, 63, 64, 64]]
    got = rows.select("i", *[bits.bit_slice(F.col("record"), *x).alias(f"c{k}") for k, x in enumerate(layouts)]).orderBy("i").collect()
    for k, x in enumerate(layouts):
        assert arrays.raw_bits(matrix, *x).view(np.int64).tolist() == [r[f"c{k}"] for r in got]


def test_small_ranges_share_tasks_reads_and_batches(tmp_path):
    """Of many small segments in small ranges: a task for a MiB of them, no byte read far beyond its range, and few batches."""
    import pyarrow as pa

    plain = Schema(ENGINE.uuid, "plain", 64, (Field("a", 0, 64),), axis_mode="implicit", axis_step=1)
    layout = container.frame(container.SCHEMA, container.put_schema(plain), 1)
    data = container.header() + b"".join(container.sync(s, 0) + layout + container.data_frame(plain, 1, s, [struct.pack("<q", s)] * 3, run=s % 7, codec_=codec.NONE) for s in range(9000))
    path = put(tmp_path, data)
    view = [(x.split()[0], container._arrow(x.split()[1].replace("long", "bigint"))) for x in container.VIEWS["records"].split(", ")]
    reader = container.RecordingReader({"path": path, "splitbytes": "4096"}, type("None", (), {"fields": []}))
    reader.arrow = pa.schema(view)
    parts = reader.partitions()
    assert len(parts) == -(-len(data) // (1 << 20)) and {p.step for p in parts} == {4096}
    batches = [b for p in parts for b in reader.read(p)]
    table = pa.Table.from_batches(batches)
    assert len(batches) <= len(parts) * 3 and sorted(zip(table["segment"].to_pylist(), table["rec_idx"].to_pylist())) == [(s, i) for s in range(9000) for i in range(3)]
    assert all(struct.unpack("<q", r)[0] == s == t and run == s % 7 for r, s, t, run in zip(*(table[c].to_pylist() for c in ("record", "segment", "axis_tick", "run_id"))))

    class Counted:
        read = 0

        def read_at(self, n, at):
            Counted.read += n
            return data[at : at + n]

    ranges = range(0, len(data), 4096)
    assert sum(container.next_sync(Counted(), len(data), at, min(at + 4096, len(data))) is not None for at in ranges) == len(ranges)
    assert Counted.read < 1.2 * len(data)


def test_bytes_are_inverted_across_blocks(tmp_path):
    data = bytes(range(256)) * 3
    path = put(tmp_path, data) + "/x.rec"
    container.overwrite_bytes(path, [0, 90, 95, 700], 5, step=100)
    assert [i for i, (a, b) in enumerate(zip(data, (tmp_path / "x.rec").read_bytes())) if a ^ b == 255] == [5, 95, 100, 705] and len(os.listdir(tmp_path)) == 1


def test_checksums_in_lanes_are_those_by_byte():
    data = bytes(np.random.default_rng(1).integers(0, 256, codec.LANES_FROM + 519, np.uint8))
    for n in (0, 1, 6, codec.LANES_FROM - 1, codec.LANES_FROM, len(data)):
        state = 0xFFFFFFFF
        for b in data[:n]:
            state = codec.BYTES[(state ^ b) & 255] ^ (state >> 8)
        assert codec.crc32c(data[:n]) == state ^ 0xFFFFFFFF


def test_values_packed_by_bytes_lie_as_by_bits():
    """Random layouts against bit after bit; absent values, values beyond their width, and numbers of other types."""
    import pyarrow as pa

    from tidemark.sources import arrays

    rng, n = np.random.default_rng(3), 50
    for big in (False, True):
        for width in (1, 7, 8, 12, 31, 33, 57, 63, 64):
            f = Field("x", int(rng.integers(0, 96 - width)), width, "sint", big)
            given = [None if i % 9 == 0 else int(x) for i, x in enumerate(rng.integers(-(1 << 62), 1 << 62, n))]
            bits = np.unpackbits(arrays.packed([f], [pa.array(given, pa.int64())], 12), axis=1, bitorder="big" if big else "little")
            for row, x in zip(bits, given):
                own = row[f.offset : f.offset + width][:: -1 if big else 1]
                assert sum(int(b) << k for k, b in enumerate(own)) == (x or 0) & ((1 << width) - 1) and row.sum() == own.sum()
    floats = [1.5, None, float("nan"), -0.0]
    for width in (16, 32, 64):
        f = Field("x", 0, width, "float")
        got = arrays.numbers(f, arrays.packed([f], [pa.array(floats)], 8))
        assert got[[0, 3]].tolist() == [1.5, 0.0] and np.signbit(got[3]) and np.isnan(got[[1, 2]]).all()
    f = Field("x", 0, 16)
    for column in (pa.array([True, None]), pa.array([1.9, float("nan")]), pa.array([1, None], pa.int32())):
        assert arrays.numbers(f, arrays.packed([f], [column], 2)).tolist() == [1, 0]
    blob = Field("x", 8, 16, "string")
    assert arrays.packed([blob], [pa.array(["é!", None, "a"])], 4).tobytes() == b"\0\xc3\xa9\0" + bytes(4) + b"\0a\0\0"


def test_written_values_are_those_of_encoded_records_without_a_worker_for_them(spark, tmp_path, monkeypatch):
    mixed = Schema(ENGINE.uuid, "mixed", 80, (Field("a", 0, 12, "sint"), Field("s", 0, 0, "string", variable=True), Field("b", 19, 13, big_endian=True), Field("c", 32, 32, "float"), Field("d", 64, 16, "bytes")), axis_mode="implicit", axis_step=1)
    rows = spark.range(0, 500, 1, 3).selectExpr("id AS axis", "id % 2 AS run_id", "CAST(id - 250 AS INT) AS a", "IF(id % 3 = 0, NULL, concat('s', id)) AS s", "id AS b", "IF(id % 5 = 0, NULL, id / 4) AS c", "CAST(concat('x', id) AS BINARY) AS d")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    container.write(container.encode(rows, mixed), one, mixed, frameRecords=40)
    monkeypatch.setattr(container, "encode", None)
    container.write_values(rows, two, mixed, frameRecords=40)
    read = lambda at: sorted((r.run_id, r.axis_tick, r.rec_idx, bytes(r.record), [bytes(x) for x in r.tails]) for r in container.read(spark, at).collect())
    assert len(read(two)) == 500 and read(one) == read(two)


def test_a_reader_holds_few_records_of_a_large_frame_as_columns(tmp_path):
    import pyarrow as pa

    plain = Schema(ENGINE.uuid, "plain", 24, (Field("a", 0, 24), Field("s", 0, 0, "string", variable=True)), axis_mode="implicit", axis_step=1)
    n = 20_001
    path = put(tmp_path, container.header() + container.sync(0, 0) + container.frame(container.SCHEMA, container.put_schema(plain), 1) + container.data_frame(plain, 1, 0, [i.to_bytes(3, "little") for i in range(n)], [[b"%d" % i] for i in range(n)]))
    reader = container.RecordingReader({"path": path}, type("None", (), {"fields": []}))
    reader.arrow = pa.schema([(x.split()[0], container._arrow(x.split()[1].replace("long", "bigint"))) for x in container.VIEWS["records"].split(", ")])
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    table = pa.Table.from_batches(batches)
    assert max(b.num_rows for b in batches) <= 8192
    assert table["rec_idx"].to_pylist() == [int.from_bytes(r, "little") for r in table["record"].to_pylist()] == [int(t[0]) for t in table["tails"].to_pylist()] == list(range(n))

"""MDF4 files built block by block, growing recordings and the kept index."""

import struct
import zlib

import numpy as np
import pytest

from tests.test_container import ENGINE, build
from tidemark.plans import storage
from tidemark.sources import container, mdf4
from tidemark.streaming import tail


class Mdf:
    """Blocks one after the other; links are places."""

    def __init__(self):
        self.data = bytearray(b"MDF     4.10    test    " + bytes(4) + struct.pack("<H", 410) + bytes(34))

    def add(self, kind, links=(), body=b""):
        self.data += bytes(-len(self.data) % 8)
        at = len(self.data)
        self.data += b"##" + kind.encode() + bytes(4) + struct.pack("<QQ", 24 + 8 * len(links) + len(body), len(links)) + b"".join(struct.pack("<q", x) for x in links) + body
        return at

    def text(self, s):
        return self.add("TX", (), s.encode() + b"\0")

    def channel(self, name, following, kind, type_, byte, width, cc=0, data=0, flags=0, invalid=0, bit=0, sync=0):
        return self.add("CN", (following, 0, self.text(name), 0, cc, data, self.text("u"), 0), struct.pack("<BBBBIIIIBBHdddddd", kind, sync, type_, bit, byte, width, flags, invalid, 0, 0, 0, *[0.0] * 6))

    def cc(self, kind, values, texts=()):
        refs = [self.text(t) for t in texts]
        return self.add("CC", (0, 0, 0, 0, *refs), struct.pack("<BBHHHdd", kind, 0, 0, len(refs), len(values), 0, 0) + struct.pack(f"<{len(values)}d", *values))

    def finish(self, path, groups):
        """groups: (name, first channel, cycles, data bytes, invalid bytes, data, id bytes, record id, flags)"""
        dg = 0
        for chain in reversed(groups):
            cg = 0
            for name, cn, cycles, n, inv, record_id, flags in reversed(chain["groups"]):
                cg = self.add("CG", (cg, cn, self.text(name), 0, 0, 0), struct.pack("<QQHHIII", record_id, cycles, flags, 0, 0, n, inv))
            dg = self.add("DG", (dg, cg, chain["data"], 0), struct.pack("<B7x", chain["id_bytes"]))
        hd = self.add("HD", (dg, 0, 0, 0, 0, 0), bytes(24))
        # the header block is expected right after the identification
        moved = bytes(self.data)
        path.write_bytes(moved[:64] + moved[64:])
        return hd


def write_mdf(tmp_path, groups_of):
    """The header block has to stand at 64, so a first pass finds its links."""
    m = Mdf()
    m.data += bytes(24 + 48 + 24)
    groups = groups_of(m)
    hd = m.finish(tmp_path / "x.mf4", groups)
    raw = bytearray((tmp_path / "x.mf4").read_bytes())
    raw[64 : 64 + 96] = raw[hd : hd + 96]
    (tmp_path / "x.mf4").write_bytes(raw)
    return str(tmp_path / "x.mf4")


def dz(m, raw, columns=0):
    body = raw
    if columns:
        n = len(raw) // columns
        body = np.frombuffer(raw[: n * columns], np.uint8).reshape(n, columns).T.tobytes() + raw[n * columns :]
    packed = zlib.compress(body)
    return m.add("DZ", (), struct.pack("<2sBBIQQ", b"DT", bool(columns), 0, columns, len(raw), len(packed)) + packed)


@pytest.mark.parametrize("cut", [None, 7, 40])
@pytest.mark.parametrize("packed", [None, 0, 13])
def test_sorted_group(spark, tmp_path, cut, packed):
    records = b"".join(struct.pack("<dhBBB", i * 0.5, -i, i % 4, i % 3, (i % 5 == 0) << 1) for i in range(50))

    def groups(m):
        pieces = [records] if cut is None else [records[k : k + cut] for k in range(0, len(records), cut)]
        blocks = [m.add("DT", (), p) if packed is None else dz(m, p, packed) for p in pieces]
        data = blocks[0] if len(blocks) == 1 else m.add("DL", (0, *blocks), struct.pack("<B3xI", 0, len(blocks)))
        cn = m.channel("state", 0, 0, 0, 11, 8, m.cc(7, [0, 1], ["zero", "one", "more"]))
        cn = m.channel("mode", cn, 0, 0, 10, 2, flags=2, invalid=1)
        cn = m.channel("temp", cn, 0, 2, 8, 16, m.cc(1, [10, 0.5]))
        cn = m.channel("t", cn, 2, 4, 0, 64, sync=1)
        return [{"groups": [("g", cn, 50, 12, 1, 0, 0)], "data": data, "id_bytes": 0}]

    frame, warnings = mdf4.read(spark, write_mdf(tmp_path, groups), "g")
    rows = frame.orderBy("axis").collect()
    assert not warnings
    assert [(r.axis, r.temp, r.mode, r.state) for r in rows] == [(i * 0.5, 10 - 0.5 * i, None if i % 5 == 0 else i % 4, ["zero", "one", "more"][i % 3]) for i in range(50)]


def test_unsorted_group_with_variable_length(spark, tmp_path):
    body = b""
    at = 0
    for i in range(20):
        text = b"x" * i + b"!"
        body += b"\2" + struct.pack("<I", len(text)) + text + b"\1" + struct.pack("<dQ", float(i), at) + b"\3\0"
        at += 4 + len(text)

    def groups(m):
        vlsd_at = m.add("CG", (0, 0, 0, 0, 0, 0), struct.pack("<QQHHIII", 2, 20, 1, 0, 0, 0, 0))
        cn = m.channel("t", m.channel("payload", 0, 1, 10, 8, 64, data=vlsd_at), 2, 4, 0, 64, sync=1)
        return [{"groups": [("bus", cn, 20, 16, 0, 1, 0), ("v", 0, 20, 0, 0, 2, 1), ("other", 0, 20, 1, 0, 3, 0)], "data": m.add("DT", (), body), "id_bytes": 1}]

    rows = mdf4.read(spark, write_mdf(tmp_path, groups), "bus")[0].orderBy("axis").collect()
    assert [(r.axis, bytes(r.payload)) for r in rows] == [(float(i), b"x" * i + b"!") for i in range(20)]


def test_two_groups_of_variable_length_and_encoded_texts(spark, tmp_path):
    body, at = b"", [0, 0]
    for i in range(12):
        texts = ["é" * i, f"ω{i}"]
        parts = [texts[0].encode("utf-16-le") + b"\0\0", texts[1].encode()]
        for k in (0, 1):
            body += bytes([2 + k]) + struct.pack("<I", len(parts[k])) + parts[k]
        body += b"\1" + struct.pack("<dQQ", float(i), *at) + f"ü{i}".encode("latin-1").ljust(6, b"\0")
        at = [x + 4 + len(p) for x, p in zip(at, parts)]

    def groups(m):
        one, two = (m.add("CG", (0, 0, 0, 0, 0, 0), struct.pack("<QQHHIII", k, 12, 1, 0, 0, 0, 0)) for k in (2, 3))
        cn = m.channel("latin", 0, 0, 6, 24, 48)
        cn = m.channel("utf8", m.channel("plain", cn, 0, 0, 24, 8), 1, 7, 16, 64, data=two)
        cn = m.channel("t", m.channel("utf16", cn, 1, 8, 8, 64, data=one), 2, 4, 0, 64, sync=1)
        return [{"groups": [("bus", cn, 12, 30, 0, 1, 0), ("v", 0, 12, 0, 0, 2, 1), ("w", 0, 12, 0, 0, 3, 1)], "data": m.add("DT", (), body), "id_bytes": 1}]

    rows = mdf4.read(spark, write_mdf(tmp_path, groups), "bus")[0].orderBy("axis").collect()
    assert [(r.utf16, r.utf8, r.latin, r.plain) for r in rows] == [("é" * i, f"ω{i}", f"ü{i}", 0xFC) for i in range(12)]


def test_refusals(tmp_path):
    (tmp_path / "a").write_bytes(b"MDF     3.30" + bytes(100))
    with pytest.raises(mdf4.MdfError):
        mdf4.read_groups(str(tmp_path / "a"))


def test_tail_reads_what_was_added(spark, tmp_path):
    data, out = build(3, 20), tmp_path / "in"
    out.mkdir()
    (out / "a.rec").write_bytes(data[: len(data) // 2])
    query = tail.read_stream(spark, str(out)).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        before = spark.table("tailed").count()
        (out / "a.rec").write_bytes(data)
        (out / "b.rec").write_bytes(build(1, 5))
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.table("tailed").collect()
    own = sorted((r.file[-5:], r.segment, r.rec_idx) for r in rows if r.stream == ENGINE.uuid)
    assert before < len(rows) and own == sorted([("a.rec", s, i) for s in range(3) for i in range(20)] + [("b.rec", 0, i) for i in range(5)])


def test_index_is_kept_and_grows(spark, tmp_path):
    path, at = tmp_path / "rec", str(tmp_path / "index")
    path.mkdir()
    (path / "a.rec").write_bytes(build(2, 10))
    first, used = storage.open_index(spark, str(path), at)
    assert not used and first.where(f"stream = '{ENGINE.uuid}'").agg({"count": "sum"}).first()[0] == 20
    assert storage.open_index(spark, str(path), at)[1]
    (path / "a.rec").write_bytes(build(3, 10))
    (path / "b.rec").write_bytes(build(1, 10))
    again, used = storage.open_index(spark, str(path), at)
    assert not used and again.where(f"stream = '{ENGINE.uuid}'").agg({"count": "sum"}).first()[0] == 40
    assert again.count() == container.read(spark, str(path), "frames").where("type = 'DATA' AND unsupported IS NULL").count()


def test_late_clock(spark):
    records = spark.createDataFrame([("f", 100), ("g", 5)], "file string, axis long")
    meta = spark.createDataFrame([("f", 1, "time.anchor", "50:1000"), ("f", 9, "time.anchor", "60:2000"), ("f", 10, "title", "x")], "file string, frame_offset long, key string, value string")
    assert {r.file: r.unix_ns for r in tail.anchored(records, meta).collect()} == {"f": 2040, "g": None}


def test_progress_is_told(spark, tmp_path):
    import time

    from tidemark.streaming.progress import Progress

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rec").write_bytes(build(1, 5))
    told = []
    listener = Progress(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    try:
        query = tail.read_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        until = time.time() + 20
        while not any(x[0] == "ended" for x in told) and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert told[0][:2] == ("started", "told") and ("progress", "told", 9) in told and told[-1][0] == "ended"


def test_index_of_rewritten_and_grown_files(spark, tmp_path):
    """A rewrite of equal size is told by its time; a file that grew is read from its last segment on; all is as if built at once."""
    import os

    path, at = tmp_path / "rec", str(tmp_path / "index")
    path.mkdir()
    (path / "a.rec").write_bytes(build(4, 10))
    (path / "b.rec").write_bytes(build(2, 10))
    storage.open_index(spark, str(path), at)
    data = bytearray(build(2, 10))
    sync = data.find(container.TOKEN, data.find(container.TOKEN) + 1)
    data[sync - 30] ^= 255
    (path / "b.rec").write_bytes(data)
    os.utime(path / "b.rec", ns=(1, 1))
    (path / "a.rec").write_bytes(build(7, 10))
    got, used = storage.open_index(spark, str(path), at)
    whole, _ = storage.open_index(spark, str(path), str(tmp_path / "other"))
    rows = [sorted(map(str, x.select(sorted(x.columns)).collect())) for x in (got, whole)]
    assert not used and rows[0] == rows[1] and len(rows[0]) == len(set(rows[0]))
    assert storage.open_index(spark, str(path), at)[1]
    (tmp_path / "index" / f"v{storage.VERSION}.json").write_text("{")
    assert not storage.open_index(spark, str(path), at)[1]
    (path / "b.rec").unlink()
    assert {r.file[-5:] for r in storage.open_index(spark, str(path), at)[0].select("file").distinct().collect()} == {"a.rec"}


@pytest.mark.parametrize("window", [(-1e18, 1e18), (0, 0), (3, 250), (1e17, 1e18)])
def test_windows_by_the_index_are_those_of_a_scan(spark, tmp_path, window):
    path = tmp_path / "rec"
    path.mkdir()
    (path / "a.rec").write_bytes(build(3, 20))
    frames, _ = storage.open_index(spark, str(path), str(tmp_path / "index"))
    for (stream,) in frames.select("stream").distinct().collect():
        schema = container.stream_schema(spark, str(path), stream)
        scan = container.decode(container.read(spark, str(path)), schema).where(f"axis >= {int(window[0])} AND axis <= {int(window[1])}")
        got = storage.window(frames, stream, int(window[0]), int(window[1]))
        assert sorted(map(str, got.collect())) == sorted(map(str, scan.collect()))
        stats = storage.statistics(frames, schema.fields[0].name)
        view = container.read(spark, str(path), "stats").where(f"stream = '{stream}' AND field = '{schema.fields[0].name}'")
        assert sorted(map(str, stats.select("frame", "n_present", "low", "high").collect())) == sorted(map(str, view.selectExpr("frame_offset AS frame", "n_present", "low", "high").collect()))


def test_a_frame_that_changed_since_is_an_error(spark, tmp_path):
    path = tmp_path / "rec"
    path.mkdir()
    (path / "a.rec").write_bytes(build(1, 20))
    frames, _ = storage.open_index(spark, str(path), str(tmp_path / "index"))
    place = frames.where(f"stream = '{ENGINE.uuid}'").first()
    container.overwrite_bytes(str(path / "a.rec"), [place.frame_offset], 20)
    schema = container.parse_schema(container.put_schema(ENGINE))
    with pytest.raises(Exception, match="isn't as the index has it"):
        container.records_at(frames, schema).count()


def test_equality_filters_reach_the_reader(spark, tmp_path):
    path = tmp_path / "rec"
    path.mkdir()
    (path / "a.rec").write_bytes(build(3, 20))
    rows = container.read(spark, str(path))
    all_of = rows.collect()
    for column in ("segment", "stream", "run_id"):
        for value in {r[column] for r in all_of}:
            assert rows.where(rows[column] == value).count() == sum(r[column] == value for r in all_of)
    assert rows.where("segment IN (0, 2) AND segment IN (2, 3)").count() == sum(r.segment == 2 for r in all_of)
    assert rows.where("file = 'none'").count() == 0
    schema = rows.schema
    reader = container.RecordingReader({"path": str(path)}, schema)
    assert list(reader.pushFilters([container.EqualTo(("segment",), 1)])) == [container.EqualTo(("segment",), 1)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == sum(r.segment == 1 for r in all_of)


def test_an_index_beside_its_recording_is_no_recording(spark, tmp_path):
    path = tmp_path / "rec"
    path.mkdir()
    (path / "a.rec").write_bytes(build(1, 20))
    storage.open_index(spark, str(path), str(path / "_index"))
    assert [p for p, _ in container.list_files(str(path))] == [str(path / "a.rec")] and storage.open_index(spark, str(path), str(path / "_index"))[1]
    assert container.list_files(str(path / "a.rec")) == container.list_files(str(path))

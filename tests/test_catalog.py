"""Catalogue views, fixtures, conversion of foreign files, cells."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from tests.test_container import ENGINE, build, put, raw_file
from tests.test_foreign import write_mdf
from tidemark import catalog, fixtures
from tidemark.functions import text
from tidemark.operators import records
from tidemark.sources import container, convert, mdf4


def test_views(spark, tmp_path):
    path = put(tmp_path, build(2, 10))
    rows = {r["name"]: r for r in catalog.streams(spark, path).collect()}
    assert rows["engine"].records == 20 and rows["sweep"].records == 8 and rows["engine"].first_tick == 0
    fields = {r["name"]: r for r in catalog.fields(spark, path, "engine").collect()}
    assert fields["boost"].guard == "mode" and fields["note"]["class"] == "event" and fields["mode"]["class"] == "categorical"
    assert [(r.run_id, r.label) for r in catalog.runs(spark, path).collect()] == [(5, "t=25")]
    assert [tuple(r) for r in catalog.meta(spark, path).collect()] == [("title", "x")]
    assert catalog.attachments(spark, path).first().bytes == 3
    some, totals, cut = catalog.frame_map(spark, path, 3)
    assert some.count() == 3 and cut and sum(r.records or 0 for r in totals.collect()) == 28
    assert {r.type: r.frames for r in catalog.frame_types(spark, path).collect()}["SYNC"] == 2
    assert [r[0] for r in catalog.unsupported(spark, path).collect()] == ["frame type 0x7f", "unbound stream"]


def test_slices_without_a_header_and_windows(spark, tmp_path):
    data = build(3, 10)
    path = put(tmp_path, data[100:])
    rows = container.read(spark, path, resync="true").where(F.col("stream") == ENGINE.uuid)
    assert {r.segment for r in rows.collect()} == {1, 2}
    whole = put(tmp_path / "w", data) if (tmp_path / "w").mkdir() is None else ""
    near = container.read(spark, whole, **{"from": "110", "to": "150"}).where(F.col("stream") == ENGINE.uuid)
    assert {r.segment for r in near.collect()} == {1}


def test_pump(spark, tmp_path):
    path = str(tmp_path / "p")
    fixtures.write_pump(spark, path, 3000)
    rows = container.decode(container.read(spark, path), fixtures.PUMP).orderBy("axis").collect()
    assert len(rows) == 3000 and rows[0].state == "off" and rows[0].dose is None and rows[0].level == 40_000
    i = 2999
    assert rows[i].axis == 10_000 * i and rows[i].flow == pytest.approx(0.05 * (5 * i + i % 7)) and rows[i].pressure == 101_325 + 2 * ((i - 4500) ** 2 // 64)


def test_filter_formula(spark):
    rows = fixtures.filter_response(spark).collect()
    assert len(rows) == 600 and {r.run_id for r in rows} == set(range(5))
    r = next(r for r in rows if r.run_id == 2 and r.i == 60)
    x = 16 * 2 ** (60 / 12) / 400
    assert r.gain == pytest.approx(-10 * math.log10(1 + x * x)) and r.phase == pytest.approx(-math.atan(x))


def test_spice_to_container(spark, tmp_path):
    points = [(10.0 ** (k % 4), complex(k, -k)) for k in range(8)]
    (tmp_path / "in").mkdir()
    schema = convert.spice_to_container(spark, put(tmp_path / "in", raw_file("complex forward", points), "a.raw"), str(tmp_path / "out"))
    rows = container.decode(container.read(spark, str(tmp_path / "out")), schema).orderBy("run_id", "axis").collect()
    assert [(r.axis, r["V(out).re"], r["V(out).im"], r.run_id) for r in rows] == [(x, y.real, y.imag, k // 4) for k, (x, y) in enumerate(points)]


def test_mdf4_to_container(spark, tmp_path):
    records = b"".join(struct.pack("<dh", i * 0.5, -i) for i in range(30))

    def groups(m):
        cn = m.channel("t", m.channel("temp", 0, 0, 2, 8, 16, m.cc(3, [])), 2, 4, 0, 64, sync=1)
        return [{"groups": [("g", cn, 30, 10, 0, 0, 0)], "data": m.add("DT", (), records), "id_bytes": 0}]

    path = write_mdf(tmp_path, groups)
    warnings = convert.mdf4_to_container(spark, path, str(tmp_path / "out"))
    assert warnings == ["g: temp: conversion 3 is not applied, raw values stay"] and mdf4.attachments(path) == []
    schema = container.stream_schema(spark, str(tmp_path / "out"))
    rows = container.decode(container.read(spark, str(tmp_path / "out")), schema).orderBy("axis").collect()
    assert [(r.axis, r.temp) for r in rows] == [(i * 0.5, -i) for i in range(30)]


def test_cells(spark):
    z = F.struct(F.lit(1.5).alias("re"), F.lit(-2.0).alias("im"))
    row = spark.range(1).select(text.cell(F.lit(800.0), "float").alias("a"), text.cell(F.lit(b"\x0a\xff"), "bytes").alias("b"), text.cell(z, "complex").alias("c"), text.cell(F.lit(None).cast("long"), "uint").alias("d"), text.cell(F.lit(True), "bool").alias("e")).first()
    assert (row.a.text, row.b.text, row.c.text, row.d.present, row.e.num) == ("800", "0aff", "1.5-2i", False, 1.0)
    assert spark.range(1).select(text.duration(F.lit(1500), -3).cast("string")).first()[0] == "INTERVAL '0 00:00:01.5' DAY TO SECOND"
    with pytest.raises(ValueError):
        text.duration(F.lit(1), -9)


def timed_mdf4(tmp_path, sync):
    """Times from -1 s on, of which one is absent by its invalidation bit."""
    times = [-1.0, 0.25, 86_400.000000001, 1e7]
    records = b"".join(struct.pack("<dhB", t, k, k == 1) for k, t in enumerate(times))

    def groups(m):
        cn = m.channel("t", m.channel("temp", 0, 0, 2, 8, 16), 2, 4, 0, 64, sync=sync, flags=2)
        return [{"groups": [("g", cn, 4, 10, 1, 0, 0)], "data": m.add("DT", (), records), "id_bytes": 0}]

    return times, write_mdf(tmp_path, groups)


def test_mdf4_times_as_ticks(spark, tmp_path):
    times, path = timed_mdf4(tmp_path, 1)
    out = str(tmp_path / "out")
    convert.mdf4_to_container(spark, path, out, ticks=True)
    schema = container.stream_schema(spark, out)
    assert (schema.axis_kind, schema.axis_exp, schema.axis_mode) == ("time", -8, "explicit")
    rows = container.decode(container.read(spark, out), schema).orderBy("temp").collect()
    assert [r.axis for r in rows] == [-(10**8), 0, 8_640_000_000_000, 10**15] and [r.t for r in rows] == [times[0], None, *times[2:]]


def test_mdf4_masters_that_count_no_time(spark, tmp_path):
    _, path = timed_mdf4(tmp_path, 2)
    convert.mdf4_to_container(spark, path, str(tmp_path / "out"), ticks=True)
    schema = container.stream_schema(spark, str(tmp_path / "out"))
    assert (schema.axis_kind, schema.axis_exp) == ("angle", 0)


def test_mdf4_files_of_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), i, None if i % 3 else i / 7) for i in range(50)], "t double, event_id long, value double")
    fixtures.write_mdf4(rows.repartition(4), str(tmp_path / "in"))
    assert len(container.list_files(str(tmp_path / "in"))) == 4
    got, warnings = mdf4.read(spark, str(tmp_path / "in"), "events")
    assert sorted((r.axis, int(r.event_id), r.value) for r in got.collect()) == sorted((r.t, r.event_id, r.value) for r in rows.collect()) and not warnings
    (tmp_path / "one").mkdir()
    other = fixtures.mdf4_bytes("events", [("t", 2, 1, 4, 0, 64, None)], struct.pack("<d", 1.0), 1, 8, 0)
    (tmp_path / "in" / "z.mf4").write_bytes(other)
    with pytest.raises(Exception, match="has other fields"):
        mdf4.read(spark, str(tmp_path / "in"), "events")[0].count()
    with pytest.raises(mdf4.MdfError):
        mdf4.read(spark, str(tmp_path / "one"), "events")


def test_spice_times_as_ticks(spark, tmp_path):
    rows = spark.createDataFrame([(0.0, 1, 2.5), (1.5e-6, 2, None), (3.0, 3, -1.0)], "t double, event_id long, value double")
    fixtures.write_spice(rows.coalesce(1), str(tmp_path / "in"))
    schema = convert.spice_to_container(spark, str(tmp_path / "in"), str(tmp_path / "out"), ticks=True)
    got = container.decode(container.read(spark, str(tmp_path / "out")), schema).orderBy("axis").collect()
    assert schema.axis_exp == -9 and [(r.axis, r["V(event_id)"], r["I(value)"]) for r in got] == [(0, 1.0, 2.5), (1500, 2.0, None), (3 * 10**9, 3.0, -1.0)]


def test_records_with_the_params_of_their_run(spark, tmp_path):
    path = put(tmp_path, build(2, 10))
    got = records.with_run_params(container.read(spark, path), container.read(spark, path, "runs"))
    assert got.count() == container.read(spark, path).count()
    assert {(r.stream == ENGINE.uuid, r.run_id, r.run_label) for r in got.collect()} == {(True, 5, "t=25"), (False, 0, None)}

"""Bit fields, conversions and axes on fixed vectors and random layouts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import axis, bits, conversions
from tidemark.sources.container import ieee

#: Record bytes, big-endian, offset, width, raw value, signed value.
VECTORS = [
    ("1234", False, 0, 16, 0x3412, None), ("1234", True, 0, 16, 0x1234, None), ("1234", False, 4, 12, 0x341, None), ("1234", True, 3, 12, 0x91A, None),
    ("0020", False, 13, 1, 1, None), ("0020", True, 10, 1, 1, None), ("78563412", False, 0, 32, 0x12345678, None), ("12345678", True, 0, 32, 0x12345678, None),
    ("FF0F", False, 0, 12, 0xFFF, -1), ("FFF0", True, 0, 12, 0xFFF, -1), ("A5", False, 1, 6, 0x12, None), ("A5", True, 1, 6, 0x12, None),
]


def test_vectors(spark):
    for record, big, offset, width, raw, signed in VECTORS:
        value = bits.bit_slice(F.unhex(F.lit(record)), offset, width, big)
        row = spark.range(1).select(value.alias("raw"), bits.sign_extend(value, width).alias("signed")).first()
        assert row.raw == raw and (signed is None or row.signed == signed)


def test_random_fields_agree_with_bit_by_bit_reading(spark):
    rng = random.Random(4)
    data, columns, want = rng.randbytes(18), [], []
    for _ in range(60):
        width, big = rng.randint(1, 64), rng.random() < 0.5
        offset = rng.randint(0, 144 - width)
        flat = [data[i // 8] >> (7 - i % 8 if big else i % 8) & 1 for i in range(offset, offset + width)]
        value = sum(b << i for i, b in enumerate(reversed(flat) if big else flat))
        want.append(value - (1 << 64) if value >> 63 else value)
        columns.append(bits.bit_slice(F.lit(bytes(data)), offset, width, big))
    assert list(spark.range(1).select(*columns).first()) == want


def test_floats(spark):
    import struct

    for width, code, whole in ((16, "<e", "<H"), (32, "<f", "<I"), (64, "<d", "<q")):
        for x in (0.0, -1.5, 3.140625, 65504.0, 2**-14, 2**-24, -0.1, float("inf"), float("nan")):
            raw = struct.unpack(whole, struct.pack(code, x))[0]
            got = spark.range(1).select(ieee(F.lit(raw).cast("long"), width)).first()[0]
            want = struct.unpack(code, struct.pack(code, x))[0]
            assert got == want or got != got and want != want


def test_unsigned_64(spark):
    row = spark.range(1).select(bits.unsigned64(F.lit(-1).cast("long")), bits.unsigned64(F.lit(5).cast("long"))).first()
    assert list(map(int, row)) == [2**64 - 1, 5]


def test_tables_hold_at_their_ends_and_absence_stays(spark):
    xs = [(v,) for v in (-5.0, 0.0, 5.0, 10.0, 15.0, 99.0, None)]
    rows = spark.createDataFrame(xs, "x double").select(conversions.table(F.col("x"), [0, 10], [1, 2]).alias("t"), conversions.table_interpolated(F.col("x"), [0, 10, 10, 20], [0, 10, 50, 60]).alias("i"), conversions.rational(F.col("x"), (0, 0, 1, 0, 1, 0)).alias("r")).collect()
    assert [r.t for r in rows] == [1, 1, 1, 2, 2, 2, None]
    assert [r.i for r in rows] == [0, 0, 5, 50, 55, 60, None]
    assert [r.r for r in rows] == [-0.2, None, 0.2, 0.1, pytest.approx(1 / 15), pytest.approx(1 / 99), None]


def test_nearest_table():
    assert conversions.nearest_table([0, 10, 30], [1, 2, 3]) == ([0, 5, 20], [1, 2, 3])


def test_complex_conversions(spark):
    z = F.struct(F.lit(1.0).alias("re"), F.lit(2.0).alias("im"))
    row = spark.range(1).select(conversions.complex_linear(z, 1, 3).alias("a"), conversions.complex_rational(z, (1, 0, 1, 0, 1, 0)).alias("b")).first()
    w = ((1 + 2j) ** 2 + 1) / (1 + 2j)
    assert (row.a.re, row.a.im) == (4, 6) and (row.b.re, row.b.im) == pytest.approx((w.real, w.imag))


def test_buckets(spark):
    b = axis.Buckets(0, 100, 10)
    assert list(spark.range(1).select(*[b.at(F.lit(x)) for x in (-1, 0, 9, 10, 99, 100)]).first()) == [None, 0, 0, 1, 9, 9]
    log = axis.Buckets(1, 1000, 3, "log")
    assert list(spark.range(1).select(*[log.at(F.lit(x)) for x in (0.5, 1.0, 50.0, 500.0, 1000.0, 0.0)]).first()) == [None, 0, 1, 2, 2, None]
    assert not axis.Buckets(-1, 10, 3, "log").log


def test_ticks(spark):
    assert list(spark.range(1).select(axis.seconds_to_ticks(F.lit(2.5), 0), axis.seconds_to_ticks(F.lit(-2.5), 0), axis.seconds_to_ticks(F.lit(0.25), -3)).first()) == [3, -3, 250]
    assert axis.tick_exponent(1.0) == -15 and axis.tick_exponent(0) == -18

"""Bit fields of binary records as Catalyst expressions.

Little-endian offsets count from the least significant bit of byte 0, big-endian ones from its most significant bit. Only the
bytes that a field touches are read. Fields that span more than eight bytes are put together from two parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(record: Column, index: int) -> Column:
    return F.conv(F.hex(F.substring(record, index + 1, 1)), 16, 10).cast("long")


def _joined(parts: list[tuple[Column, int]]) -> Column:
    out = None
    for value, shift in parts:
        moved = F.shiftleft(value, shift) if shift > 0 else F.shiftrightunsigned(value, -shift) if shift < 0 else value
        out = moved if out is None else out.bitwiseOR(moved)
    return out


def bit_slice(record: Column, offset: int, width: int, big_endian: bool = False) -> Column:
    """The unsigned field as BIGINT; a field of 64 bits keeps its bits and may read as negative."""
    if not 1 <= width <= 64:
        raise ValueError("a field has 1 to 64 bits")
    first, last = offset // 8, (offset + width - 1) // 8
    if big_endian:
        end = 8 * (last + 1) - (offset + width)
        parts = [(byte_at(record, i), 8 * (last - i) - end) for i in range(first, last + 1)]
    else:
        parts = [(byte_at(record, i), 8 * (i - first) - offset % 8) for i in range(first, last + 1)]
    value = _joined(parts)
    return value if width == 64 else value.bitwiseAND(F.lit((1 << width) - 1))


def sign_extend(raw: Column, width: int) -> Column:
    return F.shiftright(F.shiftleft(raw, 64 - width), 64 - width) if width < 64 else raw


def unsigned64(raw: Column) -> Column:
    """A 64-bit pattern as DECIMAL(20,0)."""
    value = raw.cast("decimal(20,0)")
    return F.when(raw < 0, value + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(value).cast("decimal(20,0)")


def guarded(value: Column, guard: Column, wanted: int) -> Column:
    """Absent, that is null, unless the guard's raw bits equal the wanted value."""
    return F.when(guard == F.lit(wanted), value)


def motorola_offset(start_bit: Column) -> Column:
    """The big-endian offset of a signal that a database numbers byte-wise from the least significant bit."""
    byte = F.floor(start_bit / 8)
    return (8 * byte + 7 - F.pmod(start_bit, F.lit(8))).cast("long")


def can_key(identifier: Column, extended: Column) -> Column:
    return identifier.cast("long").bitwiseOR(F.when(extended, F.lit(1 << 32)).otherwise(F.lit(0)).cast("long"))

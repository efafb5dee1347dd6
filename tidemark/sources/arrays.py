"""Frames as NumPy arrays: what a reader computes per frame without making rows of records first."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from ..model import Field, Schema


def raw_bits(records: np.ndarray, offset: int, width: int, big_endian: bool) -> np.ndarray:
    """The unsigned field of each record; records is a matrix of bytes."""
    first, last = offset // 8, (offset + width - 1) // 8
    places = [*range(last, first - 1, -1)] if big_endian else [*range(first, last + 1)]
    down = 8 * (last + 1) - (offset + width) if big_endian else offset % 8
    out = np.zeros(len(records), np.uint64)
    for k, place in enumerate(places):
        byte, shift = records[:, place].astype(np.uint64), 8 * k - down
        out |= byte << np.uint64(shift) if shift >= 0 else byte >> np.uint64(-shift)
    return out if width == 64 else out & np.uint64((1 << width) - 1)


def raw_values(f: Field, column: pa.Array) -> np.ndarray:
    """What stands in the bits of a field: absent floats as no numbers, other absent values and those that are no numbers as zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    mask, whole = (1 << f.width) - 1, pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)
    if whole:
        column = column.cast(pa.int64())
    if f.type == "float":
        kind, bits = {16: (np.float16, np.uint16), 32: (np.float32, np.uint32), 64: (np.float64, np.uint64)}[f.width]
        if whole or pa.types.is_floating(column.type):
            return column.to_numpy(zero_copy_only=False).astype(kind).view(bits).astype(np.uint64)
        return np.array([np.nan if v is None else float(v) for v in column.to_pylist()], kind).view(bits).astype(np.uint64)
    if whole:
        return column.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(mask)
    return np.array([int(v) & mask if v is not None and v == v else 0 for v in column.to_pylist()], np.uint64)


def packed(fields: Sequence[Field], columns: Sequence[pa.Array], record_bytes: int) -> np.ndarray:
    """The records of columns of raw values as a matrix of bytes: the inverse of raw_bits."""
    out = np.zeros((len(columns[0]), record_bytes), np.uint8)
    for f, column in zip(fields, columns):
        first, last = f.offset // 8, (f.offset + f.width - 1) // 8
        if f.type in ("bytes", "string"):
            for i, x in enumerate(column.to_pylist()):
                raw = (x.encode() if isinstance(x, str) else bytes(x or b""))[: f.width // 8]
                out[i, first : first + len(raw)] = np.frombuffer(raw, np.uint8)
            continue
        value = raw_values(f, column)
        places = [*range(last, first - 1, -1)] if f.big_endian else [*range(first, last + 1)]
        up = 8 * (last + 1) - (f.offset + f.width) if f.big_endian else f.offset % 8
        for k, place in enumerate(places):
            shift = 8 * k - up
            out[:, place] |= (value >> np.uint64(shift) if shift >= 0 else value << np.uint64(-shift)).astype(np.uint8)
    return out


def numbers(f: Field, records: np.ndarray) -> np.ndarray:
    """Raw values as doubles."""
    raw = raw_bits(records, f.offset, 1 if f.type == "bool" else f.width, f.big_endian)
    if f.type == "float":
        return raw.astype({16: np.uint16, 32: np.uint32, 64: np.uint64}[f.width]).view({16: np.float16, 32: np.float32, 64: np.float64}[f.width]).astype(float)
    if f.type == "sint" and f.width < 64:
        raw = raw.astype(np.int64)
        return (raw - ((raw >> (f.width - 1)) << f.width)).astype(float)
    return raw.view(np.int64).astype(float) if f.type == "sint" else raw.astype(float)


def converted(f: Field, x: np.ndarray) -> np.ndarray:
    """Physical values; labels keep the raw value, which states compare by."""
    kind, p = f.conversion.kind, f.conversion.params
    if kind == "linear":
        return p[0] + p[1] * x
    if kind == "rational":
        with np.errstate(divide="ignore", invalid="ignore"):
            return (p[0] * x * x + p[1] * x + p[2]) / (p[3] * x * x + p[4] * x + p[5])
    if kind in ("table", "table_interp") and len(p[0]):
        order = np.argsort(p[0], kind="stable")
        keys, values = np.array(p[0], float)[order], np.array(p[1], float)[order]
        if kind == "table_interp":
            return np.interp(x, keys, values)
        return values[np.maximum(np.searchsorted(keys, x, "right") - 1, 0)]
    return x


def statistics(schema: Schema, records: np.ndarray, tails: list[list[bytes]] | None) -> list[tuple]:
    """(field, n_present, low, high, first value, last value, several) of each field of a frame; blobs have no bounds."""
    out = []
    for f in schema.fields:
        there = np.ones(len(records), bool)
        if f.guard:
            g = schema.fields[f.guard[0]]
            there = raw_bits(records, g.offset, g.width, g.big_endian) == np.uint64(f.guard[1])
        if f.type in ("bytes", "string", "complex"):
            out.append((f.name, int(there.sum()), None, None, None, None, False))
            continue
        x = converted(f, numbers(f, records))
        x = x[there & np.isfinite(x)]
        out.append((f.name, len(x), float(x.min()), float(x.max()), float(x[0]), float(x[-1]), bool(x.min() != x.max())) if len(x) else (f.name, 0, None, None, None, None, False))
    return out

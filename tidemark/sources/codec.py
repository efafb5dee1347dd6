"""Checksums, compression and the byte-transpose filter of containers."""

from __future__ import annotations

import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np

NONE, ZSTD, LZ4, DEFLATE = range(4)
LANE = 512
#: From so many bytes on, lanes take less time than words in turn.
LANES_FROM = 1 << 15


def _table() -> np.ndarray:
    """CRC-32C, reflected polynomial 0x82F63B78."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0x82F63B78), crc >> 1).astype(np.uint32)
    return crc


TABLE = _table()
BYTES = TABLE.tolist()


def _advance(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Takes one byte of each lane per step; columns has a row per step."""
    for byte in columns:
        state = TABLE[(state ^ byte) & 0xFF] ^ (state >> np.uint32(8))
    return state


@lru_cache(maxsize=1)
def _words() -> tuple[array, array]:
    """What a word of four zero bytes makes of a state, by its lower and by its upper half."""
    halves, zeros = np.arange(1 << 16, dtype=np.uint32), np.zeros((4, 1), np.uint32)
    return array("I", _advance(halves, zeros).tobytes()), array("I", _advance(halves << np.uint32(16), zeros).tobytes())


@lru_cache(maxsize=64)
def _shift(n: int) -> tuple[list[int], ...]:
    """What n zero bytes make of a state, by each of its four bytes."""
    bits = _advance((np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32), np.zeros((n, 1), np.uint32))
    tables = []
    for k in range(4):
        rows = np.zeros(256, np.uint32)
        for b in range(8):
            rows[(np.arange(256) >> b & 1) == 1] ^= bits[8 * k + b]
        tables.append(rows.tolist())
    return tuple(tables)


def crc32c(data: bytes) -> int:
    """Long data in lanes of LANE bytes side by side, joined by the shift of a lane's length; the rest by words."""
    whole = len(data) // LANE * LANE if len(data) >= LANES_FROM else 0
    state = 0xFFFFFFFF
    if whole:
        lanes = np.frombuffer(data[:whole], np.uint8).reshape(-1, LANE).astype(np.uint32)
        t0, t1, t2, t3 = _shift(LANE)
        for own in _advance(np.zeros(len(lanes), np.uint32), lanes.T).tolist():
            state = t0[state & 255] ^ t1[state >> 8 & 255] ^ t2[state >> 16 & 255] ^ t3[state >> 24] ^ own
    low, high = _words()
    n = (len(data) - whole) // 4
    for word in struct.unpack_from(f"<{n}I", data, whole):
        state ^= word
        state = low[state & 0xFFFF] ^ high[state >> 16]
    for byte in data[whole + 4 * n :]:
        state = BYTES[(state ^ byte) & 255] ^ (state >> 8)
    return state ^ 0xFFFFFFFF


def transpose(data: bytes, size: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes() if size > 1 and data else data


def untranspose(data: bytes, size: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.tobytes() if size > 1 and data else data


class UnsupportedCodec(ValueError):
    pass


def compress(data: bytes, codec: int) -> bytes:
    if codec == NONE:
        return data
    if codec == ZSTD:
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    if codec == DEFLATE:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        return packer.compress(data) + packer.flush()
    raise UnsupportedCodec(f"codec {codec}")


def decompress(data: bytes, codec: int, size: int) -> bytes:
    if codec == NONE:
        out = data
    elif codec == ZSTD:
        import zstandard

        out = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    elif codec == DEFLATE:
        out = zlib.decompress(data, -15)
    else:
        raise UnsupportedCodec(f"codec {codec}")
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes where {size} are stated")
    return out

"""The words of many texts at once, in arrays: their places among the bytes, and hashes of them.

A hash is the sum of random 64-bit numbers, one for each byte at its place in the word; of words over PLACES bytes
it is a BLAKE2b digest. Two different words agree with a probability of 2**-64, whatever they are, for a table that
isn't known to who wrote them.
"""

from __future__ import annotations

import hashlib

import numpy as np

PLACES = 64
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def random_table(seed: int | None = None) -> np.ndarray:
    """A number for each place and byte; without a seed another one in each process."""
    return np.random.default_rng(seed).integers(0, 1 << 64, PLACES << 8, np.uint64)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of raw begin and end; raw ends with a blank."""
    change = np.flatnonzero(np.diff(BLANK[raw], prepend=True))
    return change[::2], change[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, *tables: np.ndarray) -> list[np.ndarray]:
    """For each table, the hash of each word."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in tables]
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    at = (np.minimum(place, PLACES - 1) << 8) | raw[~BLANK[raw]]
    found = [np.add.reduceat(table[at], first) for table in tables]
    for i in np.flatnonzero(size > PLACES).tolist():
        digest = hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=64).digest()
        for k, own in enumerate(found):
            own[i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little") ^ int(tables[k][0])
    return found

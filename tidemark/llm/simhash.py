"""SimHash near-duplicates by a binary trie self-join.

A fingerprint bit is one if it is set in more than half of the hashes of a text's word shingles. Equal fingerprints are
first merged into classes. Two classes within max_bits agree on one of max_bits + 1 blocks of bits, and within the rest
on one of max_bits + 1 smaller blocks, so classes are dealt by each such pair of blocks; no pair is missed, and even among
crafted texts a group is bounded by the values that the remaining bits can take. The remaining bits of a group form a binary trie: pairs of nodes
are traversed together from the root, their differing bits add up, and a pair is dropped as soon as it exceeds max_bits. Links are
merged at once, so that a task gives at most one link per class and group, never all pairs. Components of the links
follow in tables.

Defined results: a null text has no words; a text without words has fingerprint zero, linked like any other; fewer
words than a shingle make one shingle; rows with equal ids are fingerprinted apart and may fall in
different components; a null id is never a representative; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted_join, slices, written
from .components import components

BITS = 64
SEED = 42
CHUNK_SHINGLES = 1 << 16
CHUNK_ROWS = 1 << 16
CHUNK_PAIRS = 1 << 19


def fingerprint(text: str, width: int = 3) -> int:
    """Of the whole text: words are what bytes.split() finds, which splits at space and U+0009 to U+000D."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = [*accumulate(map(len, words), lambda a, b: a + b + 1)]
    if n <= width:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *(e + 1 for e in ends[: n - width])], ends[width - 1 :])
    digest, total, count, some = xxhash.xxh64_digest, np.zeros(BITS, np.int64), 0, []

    def add(some: list[bytes]) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)

    spans = [*spans]
    for at in range(0, len(spans), CHUNK_SHINGLES):
        some = [digest(joined[s:e], SEED) for s, e in spans[at : at + CHUNK_SHINGLES]]
        total, count = total + add(some), count + len(some)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x.as_py() or "", width) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, fp long")


def block_masks(max_bits: int) -> list[int]:
    """Masks of which two numbers that differ in max_bits bits or fewer share the bits under one at least."""

    def parts(bits: list[int]) -> list[list[int]]:
        k = max_bits + 1
        return [bits[len(bits) * i // k : len(bits) * (i + 1) // k] for i in range(k)]

    masks = []
    for block in parts([*range(BITS)]):
        rest = [b for b in range(BITS) if b not in block]
        masks += [sum(1 << b for b in block + inner) for inner in parts(rest)]
    return masks


def trie_links(group: np.ndarray, value: np.ndarray, max_bits: int) -> np.ndarray:
    """Rows are sorted by group, then value; values in a group are distinct. The least row that each row is linked to, over any path.

    A node is a span of rows with a group and leading bits in common. Spans of a pair split at the same bit; spans of
    one row each are compared by all their remaining bits.
    """
    n = len(group)
    least = np.arange(n)
    if n < 2:
        return least
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], n]
    several = ends - starts > 1
    top = int(np.bitwise_or.reduce(value)).bit_length()

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = least[a], least[b]
            odd = x != y
            if not odd.any():
                return
            a, b, x, y = a[odd], b[odd], x[odd], y[odd]
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
            while (least[least] != least).any():
                np.copyto(least, least[least])

    def split(lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
        """Where ones begin in each span, by bisection: in a node, zeros of the bit come first."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            one = (value[np.minimum(mid, n - 1)] >> bit) & np.uint64(1) == 1
            hi = np.where(open_ & one, mid, hi)
            lo = np.where(open_ & ~one, mid + 1, lo)
        return lo

    todo = [(top - 1, starts[several], ends[several], starts[several], ends[several], np.zeros(int(several.sum()), np.int8))]
    while todo:
        bit, a, a_end, b, b_end, wrong = todo.pop()
        if len(a) > CHUNK_PAIRS:
            half = len(a) // 2
            todo += [(bit, a[:half], a_end[:half], b[:half], b_end[:half], wrong[:half]), (bit, a[half:], a_end[half:], b[half:], b_end[half:], wrong[half:])]
            continue
        single = (a_end - a == 1) & (b_end - b == 1)
        if single.any():
            x, y, e = a[single], b[single], wrong[single]
            below = np.uint64((1 << (bit + 1)) - 1)
            close = e + np.bitwise_count((value[x] ^ value[y]) & below) <= max_bits
            merge(x[close], y[close])
        if bit < 0 or single.all():
            continue
        a, a_end, b, b_end, wrong = (x[~single] for x in (a, a_end, b, b_end, wrong))
        a_mid, b_mid, same = split(a, a_end, np.uint64(bit)), split(b, b_end, np.uint64(bit)), a == b
        children = [(a, a_mid, b, b_mid, wrong), (a_mid, a_end, b_mid, b_end, wrong), (a, a_mid, b_mid, b_end, wrong + 1)]
        other = ~same
        children.append((a_mid[other], a_end[other], b[other], b_mid[other], wrong[other] + 1))
        joined = [np.concatenate(x) for x in zip(*children)]
        lo, hi, lo2, hi2, e = joined
        keep = (hi > lo) & (hi2 > lo2) & (e <= max_bits) & ~((lo == lo2) & (hi - lo == 1))
        if keep.any():
            todo.append((bit - 1, *(x[keep] for x in joined)))
    return least


def squeezed(fp: np.ndarray, mask: int) -> np.ndarray:
    """The bits of fp that mask doesn't have, moved together."""
    out, at = np.zeros(len(fp), np.uint64), 0
    b = 0
    while b < BITS:
        if mask >> b & 1:
            b += 1
            continue
        run = 0
        while b + run < BITS and not mask >> (b + run) & 1:
            run += 1
        out |= ((fp >> np.uint64(b)) & np.uint64((1 << run) - 1)) << np.uint64(at)
        at, b = at + run, b + run
    return out


def links(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """classes (fp, rep). Links (a, b) between representatives that join what is within max_bits, over one or more links."""
    masks = block_masks(max_bits)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    dealt = classes.select("fp", "rep", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("mask", "bits"))
    dealt = dealt.select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("block"), "fp", "rep")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "mask", "block").sortWithinPartitions("mask", "block")

    def linked(mask: np.ndarray, block: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (block[1:] != block[:-1])])
        several = np.bincount(group)[group] > 1
        mask, group, fp, rep = mask[several], group[several], fp[several], rep[several]
        value = np.zeros(len(fp), np.uint64)
        for m in np.unique(mask):
            own = mask == m
            value[own] = squeezed(fp[own].view(np.uint64), masks[m])
        order = np.lexsort([value, group])
        group, value, rep = group[order], value[order], rep[order]
        least = trie_links(group, value, max_bits)
        other = least != np.arange(len(least))
        return pa.RecordBatch.from_arrays([pa.array(rep[other]), pa.array(rep[least[other]])], names=["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            first, last = ([c[k] for c in held[j][:2]] for j, k in ((0, 0), (-1, -1)))
            if rows >= CHUNK_ROWS and first != last:
                mask, block, fp, rep = (np.concatenate(c) for c in zip(*held))
                cut = np.flatnonzero((mask[1:] != mask[:-1]) | (block[1:] != block[:-1]))[-1] + 1
                yield linked(mask[:cut], block[:cut], fp[:cut], rep[:cut])
                held, rows = [[mask[cut:], block[cut:], fp[cut:], rep[cut:]]], len(mask) - cut
        if rows:
            yield linked(*(np.concatenate(c) for c in zip(*held)))

    return dealt.mapInArrow(join, "a long, b long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the least id that links reach."""
    prints = written(fingerprints(docs, width), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    labels = components(links(classes.where("rep IS NOT NULL"), max_bits))
    labelled = classes.join(labels, classes["rep"] == labels["a"], "left").select("fp", "n", F.coalesce("b", "rep").alias("component_id"))
    labelled = written(labelled, "labelled")
    return counted_join(prints, labelled, ["fp"], "n").select("doc_id", "fp", "component_id")

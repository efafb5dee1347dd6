"""Near copies of a Jaccard similarity of 4/5 or more between word shingles: SimHash first, the rest by an exact set join.

The binary trie of simhash links fingerprints of the same shingles; of each component the rows are compared with the first. That takes
most copies for little, but not all: sets of a similarity of 4/5 differ in ten bits of 64 on average, beyond any radius at which
a trie prunes. What it leaves is joined exactly:

Two sets of a similarity of 4/5 or more share a shingle among the fifth of each (and one more) that comes first in
any fixed order. The order takes the rarest shingles of all the rows that are left first, by their exact numbers: those that a single row holds come before
all others and are dealt nowhere, so that a row has groups only if less than a fifth of it is its own. Rows are dealt by the others among their
first and paired within each; no pair of 4/5 or more is missed. For the numbers the shingles travel packed, as four bytes and a place each per block of
rows and range of hashes, and only shared ones come back; two shingles that agree in these bits count as one, which
may add pairs to compare and loses none. Pairs are left out
by their sizes, by the places of the shared shingle in the order (what comes before it in either row is not shared, or the pair is found there) and by the parities of their shingles in slots, four or more for each shingle, which differ in no more slots than the sets in
shingles; the rest is compared by the shingles of the whole texts, each row with one of its pairs first.

First each row is compared with the first of its groups; a large group of near copies is so gone after one round. In groups that are
larger each row is then paired with the PIVOTS first rows. Rows found to be copies leave; groups that
are still larger are dealt again with GROWTH times as many pivots, until no group is left that wasn't paired whole.
Of the rows that stay no two have a similarity of 4/5 or more; each row that goes has that
to a row before it (lesser id, null ids last, then the row's place), which stays or goes for the same reason.

Defined results: words and shingles as in simhash, with A-Z lower-cased; texts without a word are copies of one another; fewer words than a shingle
make one shingle; rows with equal ids are apart; an empty table gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import dropped, give_back, hot_key_join, numbered, slices, written

WIDTH = 5
MAX_BITS = 3
SEED = 42
PIVOTS = 8
GROWTH = 16
#: The least slots of parities, and slots for each shingle.
SLOTS, SLOTS_EACH = 512, 4
CHUNK_ROWS = 1 << 16
CHUNK_PAIRS = 1 << 20
#: Pairs whose parities are compared at once.
CHUNK_PARITIES = 1 << 14
#: Shingles that a block of rows has, or a little more, and that a task counts on average, at most.
BLOCK, COUNTED = 1 << 20, 1 << 22
#: Ranges of hashes for each task that counts.
RANGES = 2
#: Pairs are joined plainly if no row is the first of more than so many.
PLAIN_ROWS = 10_000


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles, sorted."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, n))


def parities(found: np.ndarray) -> bytes:
    """Per slot, whether an odd number of shingles fall in it: a bit each, of a power of two of slots."""
    slots = max(SLOTS, 1 << (SLOTS_EACH * len(found) - 1).bit_length()) if len(found) else SLOTS
    odd = np.bincount((found & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def slots_that_differ(a: bytes, b: bytes) -> int:
    """Parities of more slots are first folded to as many as the others have."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """rows (row_id, doc_id, text). Per row its number of shingles, their digest and parities."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(x.as_py() or "", width) for x in batch.column(2)]
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            sizes = pa.array([len(x) for x in sets], pa.int64())
            odd = pa.array([parities(x) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, digests, odd], names=["row_id", "doc_id", "size", "digest", "odd"])

    return rows.mapInArrow(of, "row_id long, doc_id long, size long, digest binary, odd binary")


def cut(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of values in parts that begin at the starts."""
    ends = np.r_[starts, len(values)].astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def joined(parts: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(parts.to_pylist()), kind)


def starts_of(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where messages begin, one for each group and wherever places are more than a byte apart, and the steps from place to place inside."""
    new = np.r_[True, (group[1:] != group[:-1]) | (place[1:] - place[:-1] > 255)]
    steps = np.where(new, 0, np.r_[0, place[1:] - place[:-1]]).astype(np.uint8)
    return np.flatnonzero(new), steps


def places_of(first: np.ndarray, steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    walked = np.cumsum(steps.astype(np.int64))
    starts = np.cumsum(lengths) - lengths
    return walked + np.repeat(first - walked[starts], lengths)


def runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of the column, by which batches are sorted."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        value = batch.column(by).to_numpy()
        starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else value
        for s, e in zip(starts, [*starts[1:], len(value)]):
            if held and value[s] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = int(value[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield at, pa.Table.from_batches(held)


def first_shared(rows: DataFrame, total: int, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """rows (row_id, text) with total shingles. (row_id, key, rank): of each row its first shingles and their places, rarest first, without those that no other row has.

    A message has a block's shingles in one range of hashes, by the places of their rows in the block; one more for each block, with place -1, has
    the ids of its rows and their sizes. A task that counts holds the shingles of one range, one that chooses those of one block.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // COUNTED))
    ranges = RANGES * parts
    names = ["range", "block", "place", "steps", "bits", "often"]
    schema = "range int, block long, place int, steps binary, bits binary, often binary"

    def message(part: np.ndarray, of: np.ndarray, place: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
        often = [] if len(columns) > 2 else [pa.nulls(len(part), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(of, pa.int64()), pa.array(place, pa.int32()), *columns, *often], names=names)

    def sent(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in sets], np.uint32)
        yield message([ids[0] % ranges], [ids[0]], [-1], pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()))
        found = np.concatenate(sets)
        part = ((found >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16 if ranges < 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        part, place, bits = part[order], np.repeat(np.arange(len(sets)), sizes)[order], found[order].astype(np.uint32)
        starts, steps = starts_of(part, place)
        yield message(part[starts], np.full(len(starts), ids[0]), place[starts], cut(steps, starts), cut(bits, starts))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0
        for batch in slices(batches):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(text.as_py() or "", width)
                if len(found):
                    ids.append(row)
                    sets.append(found)
                    held += len(found)
                if held >= block:
                    yield from sent(ids, sets)
                    ids, sets, held = [], [], 0
        if held:
            yield from sent(ids, sets)
        give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in runs(batches, "range"):
            is_block = table.column("place").to_numpy() < 0
            yield from table.filter(pa.array(is_block)).to_batches()
            table = table.filter(pa.array(~is_block))
            if not table.num_rows:
                continue
            bits = joined(table.column("bits"), np.uint32)
            _, which, n = np.unique(bits, return_inverse=True, return_counts=True)
            often = n[which]
            shared = often > 1
            if not shared.any():
                continue
            lengths = pc.binary_length(table.column("steps")).to_numpy().astype(np.int64)
            place = places_of(table.column("place").to_numpy(), joined(table.column("steps"), np.uint8), lengths)[shared]
            of = np.repeat(np.arange(table.num_rows), lengths)[shared]
            rank = np.minimum(255, np.round(8 * np.log2(often[shared]))).astype(np.uint8)
            starts, steps = starts_of(of, place)
            blocks = table.column("block").to_numpy()[of[starts]]
            yield message(np.full(len(starts), part), blocks, place[starts], cut(steps, starts), cut(bits[shared], starts), cut(rank, starts))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, "block"):
            is_block = table.column("place").to_numpy() < 0
            own, table = table.filter(pa.array(is_block)), table.filter(pa.array(~is_block))
            if not table.num_rows:
                continue
            ids, sizes = joined(own.column("steps"), np.int64), joined(own.column("bits"), np.uint32).astype(np.int64)
            lengths = pc.binary_length(table.column("steps")).to_numpy().astype(np.int64)
            place = places_of(table.column("place").to_numpy(), joined(table.column("steps"), np.uint8), lengths)
            key = np.repeat(table.column("range").to_numpy().astype(np.int64) << 32, lengths) | joined(table.column("bits"), np.uint32)
            order = np.lexsort([key, joined(table.column("often"), np.uint8), place])
            place, key = place[order], key[order]
            shared = np.bincount(place, minlength=len(ids))
            wanted = sizes - (4 * sizes + 4) // 5 + 1 - (sizes - shared)
            rank = np.arange(len(place)) - (np.cumsum(shared) - shared)[place]
            first = rank < wanted[place]
            first &= np.r_[True, (place[1:] != place[:-1]) | (key[1:] != key[:-1])]
            rank = (rank + (sizes - shared)[place])[first]
            yield pa.RecordBatch.from_arrays([pa.array(ids[place[first]]), pa.array(key[first]), pa.array(rank)], names=["row_id", "key", "rank"])
        give_back()

    # In a fixed order: a task that runs again makes the same blocks.
    dealt = rows.select("row_id", "text").sortWithinPartitions("row_id").mapInArrow(send, schema).repartition(parts, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(count, schema).repartition(parts, "block").sortWithinPartitions("block").mapInArrow(choose, "row_id long, key long, rank long")


def pairs_of(n: int, pivots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of n places with the pivots places before all others, in parts."""
    for i in range(min(n - 1, pivots)):
        later = np.arange(i + 1, n)
        yield np.full(len(later), i), later


def parity_tables(odd: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of parities the row of the table that each of odd has, and the table; parities of twice the length are folded."""
    lengths, out = np.array([len(x) for x in odd]), {}
    for n in np.unique(lengths):
        same, twice = np.flatnonzero(lengths == n), np.flatnonzero(lengths == 2 * n)
        tables = [np.frombuffer(b"".join(odd[i] for i in at), np.uint64).reshape(len(at), -1, n // 8) for at in (same, twice) if len(at)]
        at = np.full(len(odd), -1)
        at[np.r_[same, twice]] = np.arange(len(same) + len(twice))
        out[int(n)] = at, np.concatenate([np.bitwise_xor.reduce(x, axis=1) for x in tables])
    return out


def may_be_near(x: np.ndarray, y: np.ndarray, size: np.ndarray, rank: np.ndarray, lengths: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Whether the entries x and y of one key, by places in size and rank, can be of a pair of 4/5 or more whose first shared shingle it is."""
    near = 5 * np.minimum(size[x], size[y]) >= 4 * np.maximum(size[x], size[y])
    near &= 9 * np.minimum(size[x] - rank[x], size[y] - rank[y]) >= 4 * (size[x] + size[y])
    if tables:
        left = np.flatnonzero(near)
        short = np.minimum(lengths[x[left]], lengths[y[left]])
        for n, (at, table) in tables.items():
            some = left[short == n]
            for i in range(0, len(some), CHUNK_PARITIES):
                part = some[i : i + CHUNK_PARITIES]
                u, v = x[part], y[part]
                near[part] = 9 * np.bitwise_count(table[at[u]] ^ table[at[v]]).sum(axis=1, dtype=np.int64) <= size[u] + size[v]
    return near


def paired(entries: DataFrame, pivots: int) -> DataFrame:
    """entries (key, doc_id, row_id, size, rank, perhaps odd). (a, b, key): rows that share a key, a before b; with a null b, a key not paired whole.

    Pairs that can't be near, or have an earlier key in common, are left out; with odd by their parities too.
    """
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["key", "row_id", "size", "rank", *(["odd"] if "odd" in entries.columns else [])]
    dealt = entries.select("doc_id", *columns).repartition(parts, "key").sortWithinPartitions("key", F.asc_nulls_last("doc_id"), "row_id").select(*columns)

    def linked(key: np.ndarray, row: np.ndarray, size: np.ndarray, rank: np.ndarray, *odd: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, len(key)])
        some, open_ = [], key[starts[counts > pivots + 1]]
        tables = parity_tables(odd[0].tolist()) if odd else {}
        lengths = np.array([len(x) for x in odd[0]]) if odd else size

        def out() -> pa.RecordBatch:
            both = np.unique(np.concatenate(some, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.nulls(both.shape[1], pa.int64())], names=["a", "b", "key"])

        several, held = counts > 1, 0
        for n in np.unique(counts[several]):
            at = starts[counts == n]
            for i, later in pairs_of(int(n), pivots):
                x, y = (at[:, None] + i[None, :]).ravel(), (at[:, None] + later[None, :]).ravel()
                near = may_be_near(x, y, size, rank, lengths, tables)
                some.append(np.stack([row[x[near]], row[y[near]]]))
                held += int(near.sum())
                if held >= CHUNK_PAIRS:
                    yield out()
                    some, held = [], 0
        if held:
            yield out()
        if len(open_):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(open_), pa.int64()), pa.nulls(len(open_), pa.int64()), pa.array(open_)], names=["a", "b", "key"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= CHUNK_ROWS and held[0][0][0] != held[-1][0][-1]:
                both = [np.concatenate(c) for c in zip(*held)]
                end = np.flatnonzero(both[0][1:] != both[0][:-1])[-1] + 1
                yield from linked(*(c[:end] for c in both))
                held, rows = [[c[end:] for c in both]], len(both[0]) - end
        if rows:
            yield from linked(*(np.concatenate(c) for c in zip(*held)))
        held.clear()
        give_back()

    return dealt.mapInArrow(join, "a long, b long, key long")


def with_both(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns that of (row_id, ...) has for each."""
    n = pairs.groupBy("a").agg(F.count("*").alias("n"))
    total, most = n.agg(F.sum("n"), F.max("n")).first()
    first, second = (of.select(F.col("row_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "ab")
    if (most or 0) <= PLAIN_ROWS:
        return pairs.join(first, "a").join(second, "b")
    return hot_key_join(pairs, first.join(n, "a"), ["a"], "n", total).drop("n").join(second, "b")


def close(pairs: DataFrame, rows: DataFrame, prints: DataFrame, width: int) -> DataFrame:
    """pairs (a, b), each once, written. (row_id): each b that has a similarity of 4/5 or more to its a."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *columns = (c.to_pylist() for c in batch.columns)
            near = [9 * slots_that_differ(x, y) <= n + m for n, m, x, y in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, ok in zip(v, near) if ok], pa.int64()) for v in (a, b)], names=["a", "b"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(x.as_py() or "", width) for x in batch.column(1)]
            ends = pa.array(np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).view(np.int64)))], names=["row_id", "found"])

    both = with_both(pairs, prints, ["size", "odd"]).where("5 * least(a_size, b_size) >= 4 * greatest(a_size, b_size)")
    likely = written(both.select("a", "b", "a_size", "b_size", "a_odd", "b_odd").mapInArrow(alike, "a long, b long"), "likely-pairs")
    if likely.isEmpty():
        return likely.select(F.col("b").alias("row_id"))
    named = likely.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
    whole = written(rows.select("row_id", "text").join(named, "row_id", "left_semi").mapInArrow(sets, "row_id long, found array<long>"), "shingle-sets")

    def compared(some: DataFrame) -> DataFrame:
        shared = F.size(F.array_intersect("a_found", "b_found"))
        near = with_both(some, whole, ["found"]).where(9 * shared >= 4 * (F.size("a_found") + F.size("b_found")))
        return written(near.select(F.col("b").alias("row_id")).distinct(), "near-copies")

    one = written(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "one-pair")
    found = compared(one)
    rest = written(likely.join(one, ["a", "b"], "left_anti").join(found.withColumnRenamed("row_id", "b"), "b", "left_anti").select("a", "b"), "other-pairs")
    if not rest.isEmpty():
        found = found.unionByName(compared(rest))
    dropped(likely, whole, one, rest)
    return found


def copies(rows: DataFrame, width: int = WIDTH, pivots: int = PIVOTS, max_bits: int = MAX_BITS) -> DataFrame:
    """rows (row_id, doc_id, text), row_id unique. (row_id) of the rows that go."""
    rows = rows.select("row_id", F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = written(sketches(rows, width), "sketches")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    stays = written(prints.groupBy("digest").agg(F.min(order)["row_id"].alias("row_id")).select("row_id"), "distinct-sets")
    gone = written(prints.select("row_id").join(stays, "row_id", "left_anti"), "exact-copies")
    own = written(prints.where("size > 0").join(stays, "row_id", "left_semi"), "own-sketches")
    dropped(prints, stays)

    linked = simhash.near_duplicates(rows.join(own, "row_id", "left_semi").select(F.col("row_id").alias("doc_id"), "text"), width, max_bits)
    linked = written(linked.select(F.col("doc_id").alias("row_id"), "component_id").join(own.select("row_id", "doc_id"), "row_id"), "linked")
    firsts = linked.groupBy("component_id").agg(F.min(order)["row_id"].alias("a"), F.count("*").alias("n")).where("n > 1")
    links = hot_key_join(linked, firsts, ["component_id"], "n", linked.count()).where("a <> row_id").select("a", F.col("row_id").alias("b"))
    fresh = close(written(links, "links"), rows, own, width)
    gone = gone.unionByName(fresh)
    left = written(own.join(fresh, "row_id", "left_anti").select("row_id", "doc_id", "size"), "left")
    total = left.agg(F.sum("size")).first()[0] or 0
    firsts = first_shared(rows.join(left.select("row_id"), "row_id", "left_semi"), total, width)
    entries = written(firsts.join(left, "row_id").select("key", "doc_id", "row_id", "size", "rank"), "entries")
    dropped(linked, left)
    seen, now = None, 1
    while True:
        found = written(paired(entries if now == 1 else entries.join(own.select("row_id", "odd"), "row_id"), now), "paired")
        new = found.where("b IS NOT NULL").select("a", "b").distinct()
        new = written(new if seen is None else new.join(seen, ["a", "b"], "left_anti"), "new-pairs")
        fresh = close(new, rows, own, width)
        gone, seen = gone.unionByName(fresh), new if seen is None else seen.unionByName(new)
        open_ = found.where("key IS NOT NULL").select("key")
        if open_.isEmpty():
            dropped(own, found, seen, entries)
            return gone
        more = written(entries.join(open_, "key", "left_semi").join(fresh, "row_id", "left_anti"), "open-groups")
        dropped(found, entries)
        entries, now = more, pivots if now < pivots else now * GROWTH


def without_copies(docs: DataFrame, width: int = WIDTH, pivots: int = PIVOTS, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the rows that go."""
    with numbered(docs) as rows:
        gone = copies(rows.select("row_id", "doc.doc_id", "doc.text"), width, pivots, max_bits)
        return written(rows.join(gone, "row_id", "left_anti").select("doc.*"), "without-copies")

"""Language-model scores by stupid backoff over word n-grams, each document under the counts of all the others.

A token is a word, A-Z lower-cased, after up to order - 1 words before it. Its score is log(count / count of its context) of the
longest n-gram that some other document holds, plus log(backoff) for each order skipped; a word that no other holds has one
in the sum of all words and one. Counts leave out the document's own, or every text would be certain under itself; nothing is pruned.

Documents are written in blocks of about block_bytes, bucketed by block. For each order, the blocks are exploded to their distinct
n-grams with counts (combined in the block) and dealt by ranges of the n-gram's 64-bit hash; in each such part of the count table the
counts of all blocks are summed and joined back to each block's n-grams. The sums meet the exploded tokens of their block, from
which the document's own counts are taken, and are summed per document. N-grams travel packed, as arrays of hashes: a row for each
would shuffle several times the input. A frequent n-gram is one entry a block, however often it occurs; rows are dealt to blocks by
number, so copies spread. The tables grow with the corpus: a part has about PART_GRAMS n-grams, a block about block_bytes.

Different n-grams of one hash, of which 10 million have one pair in 400,000 times, would count as one.

Defined results: a null or empty text has no words, score 0 and a null mean; rows with equal ids or texts are so many
documents; a document alone in its table has only unknown words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, own_shuffles, removed, shared_path, written
from .words import random_table, word_hashes, word_spans

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 4 << 20
PART_GRAMS = 1 << 20
#: Every task must hash alike.
SEED = 11


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Tokens:
    """The words of a block's texts: for each the text it is in, its place there and the hash of the n-gram it ends."""

    def __init__(self, texts: pa.ChunkedArray, table: np.ndarray):
        data = [(x.as_py() or "").encode().lower() + b"\n" for x in texts]
        raw = np.frombuffer(b"".join(data), np.uint8)
        starts, ends = word_spans(raw)
        (self.words,) = word_hashes(raw, starts, ends, table)
        limits = np.searchsorted(starts, np.cumsum([len(x) for x in data]))
        self.sizes = np.diff(np.r_[0, limits])
        self.text = np.repeat(np.arange(len(data)), self.sizes)
        self.place = np.arange(len(starts)) - np.repeat(limits - self.sizes, self.sizes)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that have n - 1 words before them, and the hashes of their n-grams."""
        ends = np.flatnonzero(self.place >= n - 1)
        out = mixed(self.words[ends - (n - 1)])
        for back in range(n - 2, -1, -1):
            out = mixed(out + self.words[ends - back])
        return ends, out


def blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, str, str, int]:
    """The table (block, doc_id, text), bucketed by block, with its name, its path and the bytes of its texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    buckets = min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    name, path = f"tidemark_blocks_{uuid.uuid4().hex}", shared_path(spark, "blocks")
    dealt = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).alias("block"), "*")
    with own_shuffles(spark):
        dealt.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name), name, path, size


def shared_counts(table: DataFrame, n: int, parts: int) -> DataFrame:
    """(block, part, own, totals): of the n-grams of each block in a part, sorted by hash, the counts in the whole table; own: their sum in the block."""
    bits = parts.bit_length() - 1

    def explode(rows: pa.Table) -> pa.Table:
        tokens = Tokens(rows["text"], random_table(SEED))
        grams, counts = np.unique(tokens.grams(n)[1], return_counts=True)
        cuts = np.searchsorted(grams, np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
        both = [(p, g, c) for p, (g, c) in enumerate(zip(np.split(grams, cuts), np.split(counts.astype(np.uint32), cuts))) if len(g)]
        columns = [pa.array([x[0] for x in both], pa.int64()), pa.array([rows["block"][0].as_py()] * len(both), pa.int64()), pa.array([x[1].tobytes() for x in both], pa.binary()), pa.array([zlib.compress(x[2].tobytes(), 1) for x in both], pa.binary())]
        return pa.Table.from_arrays(columns, names=["part", "block", "grams", "counts"])

    def total(rows: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x.as_py(), np.uint64) for x in rows["grams"]]
        counts = [np.frombuffer(zlib.decompress(x.as_py()), np.uint32) for x in rows["counts"]]
        _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)[inverse]
        ends = np.cumsum([len(x) for x in grams])
        packed = [zlib.compress(x.tobytes(), 1) for x in np.split(sums, ends[:-1])]
        return pa.Table.from_arrays([rows["block"], rows["part"], pa.array([int(x.sum()) for x in counts], pa.int64()), pa.array(packed, pa.binary())], names=["block", "part", "own", "totals"])

    exploded = table.groupBy("block").applyInArrow(explode, "part long, block long, grams binary, counts binary")
    return exploded.groupBy("part").applyInArrow(total, "block long, part long, own long, totals binary")


def token_scores(tokens: Tokens, totals: dict[int, np.ndarray], words: int, backoff: float) -> np.ndarray:
    """The score of each token; totals: by order, the counts of the sorted distinct n-grams of the block; words: of the whole table."""
    n_tokens = len(tokens.words)
    others = words - tokens.sizes[tokens.text]
    counts = {0: others}
    for n, whole in totals.items():
        ends, grams = tokens.grams(n)
        found, at = np.unique(grams, return_inverse=True)
        _, which, own = np.unique(tokens.text[ends] * len(found) + at, return_inverse=True, return_counts=True)
        counts[n] = np.zeros(n_tokens, np.int64)
        counts[n][ends] = whole[at] - own[which]
    score = -np.log(others + 1.0)
    for n in sorted(totals):
        before = np.maximum(np.arange(n_tokens) - 1, 0)
        context = counts[n - 1] if n == 1 else counts[n - 1][before]
        known = counts[n] > 0
        score = np.where(known, np.log(np.maximum(counts[n], 1) / np.maximum(context, 1)), score + np.where(tokens.place >= n - 1, np.log(backoff) if n > 1 else 0.0, 0.0))
    return score


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, score, mean_score) of each row; natural logarithms."""
    spark = docs.sparkSession
    table, name, path, size = blocks(docs, block_bytes)
    parts = 1 << max(0, size // (6 * PART_GRAMS)).bit_length()
    counted = {n: written(shared_counts(table, n, parts), f"counts-{n}") for n in range(1, order + 1)}
    words = counted[1].agg(F.sum("own")).first()[0] or 0
    schema = "doc_id long, n_words long, score double"
    names = [x.split()[0] for x in schema.split(", ")]
    everything = None
    for n, found in counted.items():
        found = found.select("block", F.lit(n).alias("n"), "part", "totals")
        everything = found if everything is None else everything.unionByName(found)

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        tokens = Tokens(rows["text"], random_table(SEED))
        totals = {n: [] for n in range(1, order + 1)}
        for n, _, packed in sorted(zip(*(found[c].to_pylist() for c in ("n", "part", "totals")))):
            totals[n].append(np.frombuffer(zlib.decompress(packed), np.int64))
        own = token_scores(tokens, {n: np.concatenate([*x, np.zeros(0, np.int64)]) for n, x in totals.items()}, words, backoff)
        sums = np.bincount(tokens.text, own, len(tokens.sizes))
        return pa.Table.from_arrays([rows["doc_id"], pa.array(tokens.sizes, pa.int64()), pa.array(sums, pa.float64())], names=names)

    scored = written(table.groupBy("block").cogroup(everything.groupBy("block")).applyInArrow(score, schema), "scores")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    removed(spark, path)
    dropped(*counted.values())
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))

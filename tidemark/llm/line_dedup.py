"""Line deduplication over levelled sorted runs of line hashes.

A run is a bucketed, sorted table of line keys (128-bit hashes), each with the number of documents of its first batch that hold it and
the largest id among them. A new batch of keys is merge-anti-joined with the runs, bucket by bucket: the keys that no run
holds become a run of their own, the others are kept as updates of counts. So each key is in one run only. Two runs of one level
are compacted into one of the next, so there are never more than log2(batches) + 1 runs and each row is rewritten as often at most. At the
end the updates are summed and added. Batches are dealt by a hash of the id.

A line's key is the line without white space (space, U+0009 to U+000D) at its ends and with A-Z lower-cased.

Defined results: a null or empty text is one empty line; rows with equal ids are one document that
holds the lines of all and are treated alike; a row with a null id is left as it is and counts for no line; an empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, hot_key_join, own_shuffles, removed, salted_left_join, shared_path, slices, written

KEY = ["h1", "h2"]


class LevelledRuns:
    """Disjoint runs of (h1, h2, n, owner), compacted pairwise level by level like a binary counter, and updates of their counts."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.runs: list[tuple[int, str, str]] = []
        self.updates: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        """One sorted file a bucket."""
        name, path = f"tidemark_run_{uuid.uuid4().hex}", shared_path(self.spark, "run")
        with own_shuffles(self.spark):
            rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, name: str, path: str, keep_files: bool = False) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if not keep_files:
            removed(self.spark, path)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a sorted batch whose keys no run holds."""
        for _, name, _ in self.runs:
            batch = batch.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """batch: unique keys with n and owner."""
        name, path = self._write(batch.select(*KEY, "n", "owner"))
        if self.runs:
            with in_bucket_order(self.spark):
                rows = self.spark.table(name)
                new = self._write(self.fresh(rows))
                for _, run, _ in self.runs:
                    self.updates.append(written(rows.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_semi"), "run-updates"))
            self._drop(name, path)
            name, path = new
        self.runs.append((0, name, path))
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            self._merge()

    def _merge(self) -> None:
        (level, a, path_a), (_, b, path_b) = self.runs[-2:]
        both = self.spark.read.schema(self.spark.table(a).schema).parquet(path_a, path_b)
        merged = self._write(both)
        self.runs[-2:] = [(level + 1, *merged)]
        self._drop(a, path_a)
        self._drop(b, path_b)

    def finish(self) -> DataFrame:
        """One row per key: compacts what is left to one run and adds the updates."""
        while len(self.runs) > 1:
            self._merge()
        (_, name, path) = self.runs[0]
        schema = self.spark.table(name).schema
        self._drop(name, path, keep_files=True)
        out = self.spark.read.schema(schema).parquet(path)
        if not self.updates:
            return out
        more = self.updates[0]
        for x in self.updates[1:]:
            more = more.unionByName(x)
        more = more.groupBy(*KEY).agg(F.sum("n").alias("more"), F.max("owner").alias("other"))
        return out.join(more, KEY, "left").select(*KEY, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("owner", "other").alias("owner"))


@contextlib.contextmanager
def in_bucket_order(spark: SparkSession) -> Iterator[None]:
    """Inside, scans of buckets of one sorted file each are known to be sorted, so that a merge join takes them as they are."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def key_of(line: str, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, None for keys that are too short."""
    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2): each long enough key of each row once."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = {key_of(line, min_chars) for line in set((text.as_py() or "").split("\n"))} - {None}
                ids += [doc_id] * len(new)
                keys += new
            halves = [pa.array([int.from_bytes(k[at : at + 8], "big", signed=True) for k in keys], pa.int64()) for at in (0, 8)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *halves], names=["doc_id", *KEY])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL").mapInArrow(hashed, "doc_id long, h1 long, h2 long")


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """(doc_id, keys array<binary>): the keys that each document has to lose."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = written(line_keys(docs, min_chars).distinct(), "line-keys")
    index = LevelledRuns(spark, buckets)
    for k in range(batches):
        part = keys.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k)
        index.add(part.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("owner")))
    repeated = index.finish().where(F.col("n") >= min_docs).select(*KEY, "n", "owner")
    lost = hot_key_join(keys, repeated, KEY, "n", keys.count()).where("doc_id <> owner")
    half = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    return lost.select("doc_id", F.concat(half("h1"), half("h2")).alias("key")).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """docs as one struct column `doc`, with kept_text, n_lines and n_dropped of each row.

    Keys found in min_docs documents or more lose all lines but those in the document of the largest id.
    """
    lost = repeated_lines(docs, min_chars, min_docs, batches)
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"))
    with_id = whole.where("doc_id IS NOT NULL")
    rows = with_id.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = salted_left_join(with_id, lost.join(rows, "doc_id"), "doc_id", "n", docs.count())
    joined = joined.unionByName(whole.where("doc_id IS NULL").withColumn("keys", F.lit(None).cast("array<binary>")), allowMissingColumns=True)
    joined = joined.select("doc", F.col("doc.text").cast("string").alias("text"), "keys")
    schema = joined.select("doc").schema.add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts, dropped = [], [], []
            for text, keys in zip(batch.column(1), batch.column(2)):
                lines, gone = (text.as_py() or "").split("\n"), set(keys.as_py() or ())
                stay = [x for x in lines if key_of(x, min_chars) not in gone] if gone else lines
                texts.append("\n".join(stay))
                counts.append(len(lines))
                dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=["doc", "kept_text", "n_lines", "n_dropped"])

    return joined.mapInArrow(kept, schema)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

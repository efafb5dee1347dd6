"""What the corpus operators share: the shared folder, written tables, joins on hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word and line definitions: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"

#: A key with at least this share of all rows (1/HOT_SLOTS) is hot. Shares sum to one, so there are at most HOT_SLOTS such keys.
HOT_SLOTS = 32_768

#: The most rows of a table whose rows are short that is broadcast after they were counted.
BROADCAST_ROWS = 20_000

#: Rows that a Python worker turns into objects at once.
SLICE_ROWS = 256


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master that has none."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_scopes: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Inside, operators write what they keep (tables, archives) into a folder of its own, which is deleted at the end.

    Results that are still to be computed read from there: write or collect them inside.
    """
    root = f"{shared_root(spark)}/scratch-{uuid.uuid4().hex}"
    _scopes.append(root)
    try:
        yield root
    finally:
        _scopes.remove(root)
        removed(spark, root)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, or in that of the innermost scratch()."""
    return f"{_scopes[-1] if _scopes else shared_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Deletes the shuffle files of each query that runs inside as it ends; what such a query wrote is all that is read later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and outlives executors."""
    path = shared_path(df.sparkSession, label)
    with own_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def numbered(docs: DataFrame) -> Iterator[DataFrame]:
    """(row_id, doc): the rows of docs as one struct column, each with a number of its own that stays.

    A table bucketed by row_id, so that joins by it don't shuffle texts; it is deleted at the end.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"tidemark_rows_{uuid.uuid4().hex}", shared_path(spark, "numbered")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("doc"))
    with own_shuffles(spark):
        rows.repartition(parts, "row_id").write.bucketBy(parts, "row_id").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, on whichever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() wrote."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            removed(df.sparkSession, path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker stays, idle, beside the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hot_key_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of left with right, which has unique keys and in weight the rows of left that have each.

    Keys with total / HOT_SLOTS rows or more number HOT_SLOTS at most, as the weights sum to total or less;
    only those are broadcast. The rest is joined by a shuffle in which no key exceeds that share.
    """
    is_hot = F.col(weight) * F.lit(HOT_SLOTS) >= F.lit(max(1, total))
    hot, cold = right.where(is_hot), right.where(~is_hot)
    by_hot = left.join(F.broadcast(hot), keys)
    by_cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return by_hot.unionByName(by_cold)


def salted_left_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, slots: int = 1024) -> DataFrame:
    """left with the row of right, which has unique keys and in weight the rows of left that have each; rows of right may be long.

    A key with more than total / slots rows is dealt to as many salts as it has such shares, fewer than slots in all; the row of
    right goes to each. Only these keys and their numbers are broadcast.
    """
    share = F.ceil(F.col(weight) * F.lit(float(slots)) / F.lit(float(max(1, total)))).cast("int")
    dealt = right.withColumn("salts", share)
    hot = F.broadcast(dealt.where("salts > 1").select(key, "salts"))
    salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int")
    spread = left.join(hot, key, "left").withColumn("salt", salt).drop("salts")
    copied = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), "salts") - 1)))
    return spread.join(copied, [key, "salt"], "left").drop("salt", "salts", weight)


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """As hot_key_join, for a right side that is written already: counts it, broadcasts it if it is small."""
    rows, total = right.agg(F.count("*"), F.sum(weight)).first()
    return left.join(F.broadcast(right), keys) if rows <= BROADCAST_ROWS else hot_key_join(left, right, keys, weight, total or 0)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

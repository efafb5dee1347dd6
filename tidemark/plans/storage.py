"""Scratch space that driver and executors share, and an index kept beside its recording.

The index has a row per DATA frame: its place, its axis extent and the statistics of its fields (both tiers), as Parquet. A manifest names
the valid table and, per file, size, time of the last change and the hash of its first bytes. It is replaced in one step after the table is
whole, so that a build that dies changes nothing. A file that is as the manifest has it isn't opened; one that grew is read from its last
indexed segment on; any other is read whole. Schemas are always read from the recording itself.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SchemaError
from ..sources import container

VERSION = 2
#: So many first bytes of a file are hashed.
HEAD_BYTES = 4096
#: About so many bytes of frames are read by one task.
TASK_BYTES = 128 << 20


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder only for a local master that has none."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def head_hash(path: str, size: int) -> str:
    """Of the first bytes of a file that had this size."""
    store, inner = container.open_store(path)
    with store.open_input_file(inner) as file:
        return hashlib.sha256(file.read_at(min(HEAD_BYTES, size), 0)).hexdigest()


def manifest_of(at: str) -> dict | None:
    """None without a manifest of this version, or with one that can't be read as such."""
    store, inner = container.open_store(f"{at}/v{VERSION}.json")
    if not store.get_file_info(inner).is_file:
        return None
    with store.open_input_file(inner) as file:
        try:
            found = json.loads(file.read())
        except ValueError:
            return None
    return found if isinstance(found, dict) and {"table", "files"} <= found.keys() else None


def put_manifest(at: str, manifest: dict) -> None:
    store, inner = container.open_store(at)
    store.create_dir(inner, recursive=True)
    name = f"{inner}/.{uuid.uuid4().hex}"
    with store.open_output_stream(name, compression=None) as out:
        out.write(json.dumps(manifest).encode())
    store.move(name, f"{inner}/v{VERSION}.json")


def open_index(spark: SparkSession, path: str, at: str) -> tuple[DataFrame, bool]:
    """(rows of the container view `index`, whether the kept index answered as it is). The table before the last one is deleted with each build, so that a query on the last one ends."""
    states = {p: [size, changed] for p, size, changed in container.list_states(path)}
    manifest = manifest_of(at)
    known = manifest["files"] if manifest else {}
    if manifest and {p: x[:2] for p, x in known.items()} == states:
        return spark.read.parquet(f"{at}/{manifest['table']}"), True
    changed = [p for p, x in states.items() if p not in known or known[p][:2] != x]
    with ThreadPoolExecutor(16) as pool:
        heads = dict(zip(changed, pool.map(lambda p: head_hash(p, states[p][0]), changed)))
        longer = [p for p in changed if p in known and states[p][0] > known[p][0]]
        grown = [p for p, h in zip(longer, pool.map(lambda p: head_hash(p, known[p][0]), longer)) if h == known[p][2]]
    new = container.read(spark, path, "index")
    if manifest:
        kept = spark.read.parquet(f"{at}/{manifest['table']}")
        last = dict(kept.join(_files(spark, [(p, 0) for p in grown]), "file").groupBy("file").agg(F.max("sync")).collect())
        new = container.read(spark, path, "index", places=json.dumps({p: last.get(p, 0) for p in changed}))
        stay = [(p, last[p] if p in last else None) for p in states if p not in changed or p in last]
        new = kept.join(_files(spark, stay), "file").where("begin IS NULL OR sync < begin").drop("begin").unionByName(new)
    table = f"frames-{uuid.uuid4().hex}"
    new.write.parquet(f"{at}/{table}")
    files = {p: [*x, heads[p] if p in heads else known[p][2]] for p, x in states.items()}
    put_manifest(at, {"table": table, "files": files, "before": manifest["table"] if manifest else None})
    if manifest and manifest.get("before"):
        store, inner = container.open_store(f"{at}/{manifest['before']}")
        if store.get_file_info(inner).type.name == "Directory":
            store.delete_dir(inner)
    return spark.read.parquet(f"{at}/{table}"), False


def _files(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "file string, begin long")


def statistics(frames: DataFrame, field: str) -> DataFrame:
    """The index of one field as the operators take statistics: a row per frame. Frames of streams without the field are left out."""
    own = frames.withColumn("own", F.get(F.filter("fields", lambda x: x["field"] == F.lit(field)), F.lit(0))).where("own IS NOT NULL AND count > 0")
    return own.select("file", "segment", "run_id", F.col("frame_offset").alias("frame"), "count", F.col("axis_low").alias("first"), F.col("axis_high").alias("last"), "own.n_present", "own.low", "own.high", "own.first_value", "own.last_value", "own.several")


def window(frames: DataFrame, stream: str, start, end) -> DataFrame:
    """The decoded records of a stream (its identity) with an axis position in [start, end]; only frames that the index doesn't rule out are read."""
    hit = frames.where((F.col("stream") == stream) & (F.col("axis_high") >= F.lit(float(start))) & (F.col("axis_low") <= F.lit(float(end))))
    first, layouts, total, n = hit.agg(F.min(F.struct("file", "sync", "frame_offset")), F.count_distinct("layout"), F.sum("frame_bytes"), F.count("*")).first()
    if not n:
        first = frames.where(F.col("stream") == stream).agg(F.min(F.struct("file", "sync", "frame_offset"))).first()[0]
    if first is None:
        raise SchemaError(f"{stream}: no such stream")
    if layouts > 1:
        raise SchemaError(f"{stream}: restated with another layout")
    schema = container.schema_at(*first)
    cores = frames.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n, max(cores, -(-(total or 0) // TASK_BYTES))))
    rows = container.decode(container.records_at(hit.repartition(parts, "file", "frame_offset"), schema), schema)
    return rows.where((F.col("axis") >= F.lit(start)) & (F.col("axis") <= F.lit(end)))

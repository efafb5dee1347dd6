"""What a recording holds: streams with their spans, fields, runs, meta, attachments, and frames by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.records import field_class
from .sources import container


def streams(spark: SparkSession, path: str) -> DataFrame:
    """One row per stream, those without a record too: name, layout, records, segments."""
    bound = container.read(spark, path, "streams").groupBy("stream").agg(*[F.min_by(c, F.struct("file", "segment")).alias(c) for c in ("name", "record_bits", "n_fields", "axis_kind", "axis_mode", "axis_exp", "axis_unit")])
    frames = container.read(spark, path, "frames").where("type = 'DATA' AND unsupported IS NULL")
    counts = frames.groupBy("stream").agg(F.sum("count").alias("records"), F.count("*").alias("frames"), F.min("axis_tick").alias("first_tick"))
    return bound.join(counts, "stream", "left").fillna(0, ["records", "frames"]).orderBy("name")


def fields(spark: SparkSession, path: str, stream: str) -> DataFrame:
    schema = container.stream_schema(spark, path, stream)
    rows = [(i, f.name, f.type, field_class(f.type, f.conversion.kind), f.offset, f.width, f.big_endian, f.conversion.kind, f.unit, f.desc, schema.fields[f.guard[0]].name if f.guard else None) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "position int, name string, type string, class string, offset int, width int, big_endian boolean, conversion string, unit string, desc string, guard string")


def runs(spark: SparkSession, path: str) -> DataFrame:
    from .operators.records import run_label

    return container.read(spark, path, "runs").groupBy("run_id").agg(F.min("run_index").alias("run_index"), F.min_by("params", F.struct("file", "segment")).alias("params")).withColumn("label", run_label(F.col("params"))).orderBy("run_id")


def meta(spark: SparkSession, path: str) -> DataFrame:
    """In file order; a key may come several times."""
    return container.read(spark, path, "meta").orderBy("file", "frame_offset").select("key", "value")


def attachments(spark: SparkSession, path: str) -> DataFrame:
    return container.read(spark, path, "attachments").select("name", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("sha256"), "data").orderBy("name")


def frame_map(spark: SparkSession, path: str, limit: int = 4000) -> tuple[DataFrame, DataFrame, bool]:
    """(frames up to a limit, totals over all segments, whether the frames were cut)"""
    frames = container.read(spark, path, "frames")
    totals = frames.groupBy("file", "segment").agg(F.count("*").alias("frames"), F.sum("count").alias("records"), F.count_if(F.col("type") == "SCHEMA").alias("schemas"), F.count_if(F.col("type") == "RUN").alias("runs"), F.max(F.col("frame_offset") + F.col("payload_bytes") + 12).alias("end"))
    limit = min(limit, 100_000)
    return frames.orderBy("file", "frame_offset").limit(limit), totals.orderBy("file", "segment"), frames.count() > limit


def frame_types(spark: SparkSession, path: str) -> DataFrame:
    return container.read(spark, path, "frames").groupBy("type").agg(F.count("*").alias("frames"), F.sum("payload_bytes").alias("bytes"))


def unsupported(spark: SparkSession, path: str) -> DataFrame:
    """The distinct causes, sorted."""
    return container.read(spark, path, "frames").where("unsupported IS NOT NULL").select("unsupported").distinct().orderBy("unsupported")

"""The two index tiers: frames with their extents, and statistics per frame and field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = ["segment", "run_id", "frame"]


def frame_index(records: DataFrame) -> DataFrame:
    """One row per frame: count, first and last axis position in record order."""
    order = F.struct("axis", "seq")
    return records.groupBy(*FRAME).agg(F.count("*").alias("count"), F.min_by("axis", order).alias("first"), F.max_by("axis", order).alias("last"))


def frame_stats(records: DataFrame, value: Column, bounds: bool = True) -> DataFrame:
    """One row per frame: min, max, first and last present value, n_present, and whether it holds several values.

    Absent values are skipped by a conditional order, so frames without any value keep their row with n_present = 0. One pass
    with partial aggregation; frames needn't be joined.
    """
    rows = records.withColumn("_v", value)
    order = F.when(F.col("_v").isNotNull(), F.struct("axis", "seq"))
    extent = F.struct("axis", "seq")
    parts = [F.count("*").alias("count"), F.min_by("axis", extent).alias("first"), F.max_by("axis", extent).alias("last"), F.count("_v").alias("n_present")]
    if bounds:
        parts += [F.min("_v").alias("low"), F.max("_v").alias("high"), F.min_by("_v", order).alias("first_value"), F.max_by("_v", order).alias("last_value")]
    out = rows.groupBy(*FRAME).agg(*parts)
    return out.withColumn("several", F.coalesce(F.col("low") != F.col("high"), F.lit(False))) if bounds else out


def overlapping(frames: DataFrame, start, end, run: int | None = None) -> DataFrame:
    """Frames whose closed extent meets the window, of one run if given."""
    hit = (F.col("last") >= F.lit(start)) & (F.col("first") <= F.lit(end))
    return frames.where(hit if run is None else hit & (F.col("run_id") == F.lit(run)))


def inside(start, end) -> Column:
    return (F.col("first") >= F.lit(start)) & (F.col("last") <= F.lit(end))


def span(frames: DataFrame) -> DataFrame:
    return frames.where("count > 0").groupBy("run_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("count").alias("records"))


def segment_totals(frames: DataFrame) -> DataFrame:
    return frames.groupBy("segment").agg(F.count("*").alias("frames"), F.sum("count").alias("records"), F.countDistinct("run_id").alias("runs"), F.max("last").alias("last"))


def window_count(frames: DataFrame, start, end, run: int | None = None) -> DataFrame:
    """An upper bound of the records in a window, from the index alone, and whether it is exact."""
    hit = overlapping(frames, start, end, run)
    return hit.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.coalesce(F.bool_and(inside(start, end)), F.lit(True)).alias("total_exact"), F.count("*").alias("frames"))


def grown(cached: DataFrame, tail: DataFrame, resume: int) -> DataFrame:
    """An index after its recording grew: the last segment, read again, replaces what the cache has of it."""
    return cached.where(F.col("segment") < F.lit(resume)).unionByName(tail.where(F.col("segment") >= F.lit(resume)))

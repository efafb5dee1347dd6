"""Tier choice: exact answers while few frames meet the window, statistics beyond. The answer names its tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Buckets
from ..operators import decimate, index
from ..operators.records import DECODE_FRAMES, DEFAULT_POINTS, EXACT_EVENTS, LARGEST_POINTS, QueryError


def _frames(stats: DataFrame, start, end, run: int | None) -> tuple[DataFrame, int, int]:
    hit = index.overlapping(stats, start, end, run)
    found = hit.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    return hit, found[0], found[1]


def _of_run(records: DataFrame, run: int | None) -> DataFrame:
    return records if run is None else records.where(F.col("run_id") == F.lit(run))


def envelope(records: DataFrame, stats: DataFrame, start, end, points: int = DEFAULT_POINTS, run: int | None = None, scale: str = "linear", value: str = "value", kind: str = "numeric", most_frames: int = DECODE_FRAMES) -> DataFrame:
    """run_id, x, min, max, n, tier, exact. Samples as they are if no more than points meet the window."""
    if kind != "numeric":
        raise QueryError("an envelope needs a numeric field")
    points = max(1, min(points, LARGEST_POINTS))
    hit, frames, _ = _frames(stats, start, end, run)
    columns = ["run_id", "x", "min", "max", "n"]
    if frames > most_frames:
        out = decimate.from_stats(hit.withColumnsRenamed({"low": "min", "high": "max"}), ["run_id"], Buckets(start, end, points, scale))
        return out.select(*columns, F.lit("stats").alias("tier"), F.lit(False).alias("exact"))
    rows = _of_run(records, run)
    most = decimate.in_window(rows, start, end).groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    if most <= points:
        return decimate.samples(rows, ["run_id"], start, end, value).select(*columns, F.lit("exact").alias("tier"), F.lit(True).alias("exact"))
    return decimate.bucketed(rows, ["run_id"], Buckets(start, end, points, scale), value).select(*columns, F.lit("exact").alias("tier"), F.lit(False).alias("exact"))


def states(records: DataFrame, stats: DataFrame, start, end, points: int = DEFAULT_POINTS, run: int | None = None, value: str = "state", kind: str = "categorical", most_frames: int = DECODE_FRAMES) -> DataFrame:
    """run_id, x0, x1, raw, mixed, absent, tier."""
    if kind != "categorical":
        raise QueryError("state bands need a categorical field")
    points = max(1, min(points, LARGEST_POINTS))
    hit, frames, _ = _frames(stats, start, end, run)
    columns = ["run_id", "x0", "x1", "raw", "mixed", "absent"]
    if frames > most_frames:
        return decimate.states_from_stats(hit, ["run_id"], start, end).select(*columns, F.lit("stats").alias("tier"))
    rows = _of_run(records, run)
    runs = decimate.states(rows, ["run_id"], start, end, value, "frame").withColumn("mixed", F.lit(False))
    most = runs.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    out = runs if most <= points else decimate.states_bucketed(rows, ["run_id"], Buckets(start, end, points), value)
    return out.select(*columns, F.lit("exact").alias("tier"))


def exact_events(records: DataFrame, text: str, start, end) -> DataFrame:
    rows = decimate.in_window(records, start, end).where(F.col(text).isNotNull())
    return rows.select("run_id", "axis", "seq", F.col(text).alias("text"))


def events(records: DataFrame, stats: DataFrame, start, end, run: int | None = None, text: str = "text", kind: str = "event", most_frames: int = DECODE_FRAMES) -> tuple[DataFrame, str]:
    """(events or densities, tier)."""
    if kind != "event":
        raise QueryError("an event lane needs an event field")
    hit, frames, n = _frames(stats, start, end, run)
    if frames <= most_frames and n <= EXACT_EVENTS:
        return exact_events(_of_run(records, run), text, start, end), "exact"
    return decimate.event_density(hit, ["run_id"], start, end), "stats"

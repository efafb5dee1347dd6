"""Reductions of a series to what a screen can show: envelopes, state bands, event lanes.

A series has key columns (stream, run), axis, seq (breaks ties of the axis) and a value, null where it is absent. Windows are
literals, so filters reach the scan and no plan needs a one-row join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import Buckets


def in_window(series: DataFrame, start, end) -> DataFrame:
    return series.where(F.col("axis").between(F.lit(start), F.lit(end)))


def _spine(keys: DataFrame, buckets: Buckets) -> DataFrame:
    return keys.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets.n - 1))))


def bucketed(series: DataFrame, keys: list[str], buckets: Buckets, value: str = "value") -> DataFrame:
    """keys, bucket, x, min, max, n: every bucket of every key; empty ones are absent with n = 0."""
    found = in_window(series, buckets.start, buckets.end).withColumn("bucket", buckets.at(F.col("axis"))).where("bucket IS NOT NULL")
    sums = found.groupBy(*keys, "bucket").agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    spine = _spine(sums.select(*keys).distinct(), buckets)
    return spine.join(sums, [*keys, "bucket"], "left").select(*keys, "bucket", buckets.centre(F.col("bucket")).alias("x"), "min", "max", F.coalesce("n", F.lit(0)).alias("n"))


def samples(series: DataFrame, keys: list[str], start, end, value: str = "value") -> DataFrame:
    """The samples of a window as an envelope of their own."""
    v = F.col(value)
    return in_window(series, start, end).select(*keys, F.col("axis").cast("double").alias("x"), v.alias("min"), v.alias("max"), F.when(v.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n"))


def from_stats(frames: DataFrame, keys: list[str], buckets: Buckets) -> DataFrame:
    """The envelope out of per-frame statistics (keys, first, last, min, max, n_present).

    The bounds of a frame widen every bucket that it spans, so no bucket is narrower than the samples' own; the count is spread evenly,
    one at least.
    """
    low, high = buckets.at(F.col("first")), buckets.at(F.col("last"))
    a, b = F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(buckets.n - 1))
    spans = frames.where((F.col("n_present") > 0) & (low.isNotNull() | high.isNotNull())).withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    share = F.greatest(F.lit(1), F.floor(F.col("n_present") / (F.col("hi") - F.col("lo") + 1))).cast("long")
    spread = spans.withColumn("share", share).withColumn("bucket", F.explode(F.sequence("lo", "hi")))
    sums = spread.groupBy(*keys, "bucket").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("share").alias("n"))
    spine = _spine(sums.select(*keys).distinct(), buckets)
    return spine.join(sums, [*keys, "bucket"], "left").select(*keys, "bucket", buckets.centre(F.col("bucket")).alias("x"), "min", "max", F.coalesce("n", F.lit(0)).alias("n"))


def states(series: DataFrame, keys: list[str], start, end, value: str = "value", frame: str | None = None) -> DataFrame:
    """keys, run_no, x0, x1, raw, absent: maximal runs of one value; a run lasts until the next begins, the last one to the end.

    With a frame column (which grows with the axis) changes are found per frame, so that one long run of a stream is many tasks; only
    the first record of a frame is compared with the frame before, by way of one row per frame.
    """
    parts = [*keys, frame] if frame else keys
    order = Window.partitionBy(*parts).orderBy("axis", "seq")
    rows = in_window(series, start, end).select(*parts, "axis", "seq", F.col(value).alias("raw"))
    flagged = rows.withColumn("leads", F.row_number().over(order) == 1).withColumn("changes", ~F.col("raw").eqNullSafe(F.lag("raw").over(order)))
    begun = flagged.where(F.col("leads") | F.col("changes"))
    if frame:
        last = rows.groupBy(*parts).agg(F.max_by(F.struct("raw"), F.struct("axis", "seq")).alias("last"))
        before = last.select(*parts, F.lag("last").over(Window.partitionBy(*keys).orderBy(frame)).alias("before"))
        begun = begun.join(before, parts, "left")
        begun = begun.where(~F.col("leads") | F.col("before").isNull() | ~F.col("raw").eqNullSafe(F.col("before.raw")))
    return _bands(begun, keys, end)


def _bands(begun: DataFrame, keys: list[str], end) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("axis", "seq")
    following = F.coalesce(F.lead("axis").over(order), F.lit(end))
    return begun.select(*keys, F.row_number().over(order).alias("run_no"), F.col("axis").alias("x0"), following.alias("x1"), "raw", F.col("raw").isNull().alias("absent"))


def states_bucketed(series: DataFrame, keys: list[str], buckets: Buckets, value: str = "value") -> DataFrame:
    """keys, bucket, x0, x1, raw, mixed, absent: for more runs than buckets. A bucket of several values is mixed and names none."""
    found = in_window(series, buckets.start, buckets.end).withColumn("bucket", buckets.at(F.col("axis"))).where(F.col("bucket").isNotNull() & F.col(value).isNotNull())
    sums = found.groupBy(*keys, "bucket").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    every = _spine(in_window(series, buckets.start, buckets.end).select(*keys).distinct(), buckets).join(sums, [*keys, "bucket"], "left")
    mixed = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    return every.select(*keys, "bucket", buckets.edge(F.col("bucket")).alias("x0"), buckets.edge(F.col("bucket") + 1).alias("x1"), F.when(~mixed, F.col("low")).alias("raw"), mixed.alias("mixed"), F.col("low").isNull().alias("absent"))


def states_from_stats(frames: DataFrame, keys: list[str], start, end) -> DataFrame:
    """keys, band, x0, x1, raw, mixed, absent: bands of frames; neighbours of one kind and value are one band.

    frames: keys, frame, first, last, n_present, low, high (least and greatest value). A band ends where its last frame does.
    """
    x0, x1 = F.greatest("first", F.lit(start)), F.least("last", F.lit(end))
    absent = F.col("n_present") == 0
    mixed = ~absent & (F.col("low") != F.col("high"))
    bands = frames.select(*keys, "frame", x0.alias("x0"), x1.alias("x1"), absent.alias("absent"), mixed.alias("mixed"), F.when(~absent & ~mixed, F.col("low")).alias("raw")).where("x1 >= x0")
    order = Window.partitionBy(*keys).orderBy("x0", "frame")
    kind = F.struct("absent", "mixed", "raw")
    changed = F.coalesce((~kind.eqNullSafe(F.lag(kind).over(order))).cast("int"), F.lit(1))
    numbered = bands.withColumn("changed", changed).withColumn("band", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "band").agg(F.min("x0").alias("x0"), F.max_by("x1", F.struct("x0", "frame")).alias("x1"), F.first("raw").alias("raw"), F.first("mixed").alias("mixed"), F.first("absent").alias("absent"))


def event_density(frames: DataFrame, keys: list[str], start, end) -> DataFrame:
    """keys, x0, x1, n: frames with events, clamped to the window."""
    inside = frames.where((F.col("n_present") > 0) & (F.col("last") >= F.lit(start)) & (F.col("first") <= F.lit(end)))
    return inside.select(*keys, F.greatest("first", F.lit(start)).alias("x0"), F.least("last", F.lit(end)).alias("x1"), F.col("n_present").alias("n"))


def run_numbers(points: DataFrame, keys: list[str], order_by: list[str], axis: str = "axis") -> Column:
    """A new run wherever the axis goes back."""
    order = Window.partitionBy(*keys).orderBy(*order_by)
    return F.sum(F.coalesce((F.col(axis) < F.col("_previous")).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))


def detect_runs(points: DataFrame, keys: list[str], order_by: list[str], axis: str = "axis") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(*order_by)
    return points.withColumn("_previous", F.lag(axis).over(order)).withColumn("run_no", run_numbers(points, keys, order_by, axis)).drop("_previous")

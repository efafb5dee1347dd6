"""Record pages, exports and catalogues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import inside, overlapping, window_count

#: Page sizes and limits of the query surface.
DEFAULT_PAGE, LARGEST_PAGE, EXPORT_LIMIT, DECODE_FRAMES, EXACT_EVENTS, DEFAULT_POINTS, LARGEST_POINTS = 200, 5000, 2_000_000, 256, 2000, 1000, 20_000


class QueryError(ValueError):
    """A request that the recording can't answer."""


def window(start, end, first, last) -> tuple:
    """Missing ends are the stream's own, reversed ones are swapped."""
    a, b = first if start is None else start, last if end is None else end
    return (a, b) if a <= b else (b, a)


def _page(records: DataFrame, frames: DataFrame, start, end, offset: int, limit: int, run: int | None) -> tuple[DataFrame, int]:
    """(records of the window from offset on, in frame order, as many as limit at least if there are; frames that are read for them)"""
    hit = overlapping(frames, start, end, run)
    exact = F.when(inside(start, end), F.col("count")).otherwise(F.lit(0))
    sums = hit.withColumn("sure", exact).groupBy("segment").agg(F.sum("count").alias("most"), F.sum("sure").alias("least"))
    order = Window.orderBy("segment")
    before = sums.select("segment", *[(F.sum(c).over(order) - F.col(c)).alias(f"{c}_before") for c in ("most", "least")])
    inner = Window.partitionBy("segment").orderBy("run_id", "frame")
    sums = hit.withColumn("sure", exact).withColumns({"most": F.sum("count").over(inner), "least": F.sum("sure").over(inner) - F.col("sure")}).join(before, "segment")
    sums = sums.select("segment", "run_id", "frame", "sure", (F.col("most_before") + F.col("most")).alias("most_to"), (F.col("least_before") + F.col("least")).alias("least_before"))
    early = (F.col("sure") > 0) & (F.col("most_to") <= F.lit(offset))
    wanted = ~early & (F.col("least_before") < F.lit(offset + limit))
    skipped, read = sums.agg(F.coalesce(F.sum(F.when(early, F.col("sure"))), F.lit(0)), F.count_if(wanted)).first()
    keys = ["segment", "run_id", "frame"]
    chosen = sums.where(wanted).select(*keys)
    rows = records.join(F.broadcast(chosen) if read <= LARGEST_POINTS else chosen, keys, "left_semi")
    return rows.where(F.col("axis").between(start, end)).orderBy(*keys, "axis", "seq").offset(int(offset - skipped)), read


def _limit(limit: int) -> int:
    return min(limit if limit > 0 else DEFAULT_PAGE, LARGEST_PAGE)


def record_page(records: DataFrame, frames: DataFrame, start, end, offset: int = 0, limit: int = DEFAULT_PAGE, run: int | None = None) -> DataFrame:
    """Records offset to offset + limit of a window, in frame order.

    A frame that lies wholly inside the window is skipped by its count if it ends before the page even when all records of the
    frames before it are in the window; so is any frame before which the frames wholly inside fill the page. Only the others are
    read. Running sums are per segment, over the index.
    """
    limit = _limit(limit)
    return _page(records, frames, start, end, offset, limit, run)[0].limit(limit)


@dataclass(frozen=True)
class PageInfo:
    """What goes with a page: whether records follow it, the records of the window by the index, whether that number is exact or an upper
    bound, and how many frames the page reads."""

    more: bool
    total: int
    total_exact: bool
    decoded: int


def page_info(records: DataFrame, frames: DataFrame, start, end, offset: int = 0, limit: int = DEFAULT_PAGE, run: int | None = None) -> PageInfo:
    """Of record_page with the same arguments."""
    limit = _limit(limit)
    following, read = _page(records, frames, start, end, offset, limit + 1, run)
    counted = window_count(frames, start, end, run).first()
    return PageInfo(following.limit(limit + 1).count() > limit, counted.total, counted.total_exact, read)


def with_run_params(records: DataFrame, runs: DataFrame) -> DataFrame:
    """records with the params of their run and its label; null where the recording doesn't tell the run. runs is the container view of that
    name; a run that is restated within a file and segment has the params that come first in its index."""
    one = runs.groupBy("file", "segment", "run_id").agg(F.min_by("params", "run_index").alias("params"))
    return records.join(one, ["file", "segment", "run_id"], "left").withColumn("run_label", run_label(F.col("params")))


def export_csv(records: DataFrame, frames: DataFrame, path: str, start, end, columns: list[str], units: dict[str, str] | None = None, most: int = EXPORT_LIMIT) -> None:
    """Axis, run and cells as CSV, absent ones empty. The index refuses exports that are too large before anything is decoded."""
    unknown = [c for c in columns if c not in records.columns]
    if unknown:
        raise QueryError(f"unknown columns: {', '.join(unknown)}")
    if (n := window_count(frames, start, end).first().total) > most:
        raise QueryError(f"{n} records are more than {most}; narrow the window")
    named = [F.col(c).alias(f"{c} [{u}]" if (u := (units or {}).get(c)) else c) for c in columns]
    records.where(F.col("axis").between(start, end)).select(F.col("axis"), F.col("run_id").alias("run"), *named).write.csv(path, header=True, nullValue="", emptyValue='""')


def run_label(params: Column) -> Column:
    """k=v k=v, in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


def field_class(kind: str, conversion: str | None = None) -> str:
    if kind in ("bytes", "string"):
        return "event"
    if kind == "complex":
        return "blob"
    return "categorical" if kind == "bool" or conversion in ("value_to_text", "range_to_text") else "numeric"

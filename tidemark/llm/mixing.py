"""Mixing sources to target weights: repetition rates per source, then whole copies and one seeded draw.

Sizes are summed per source with map-side combining, so a hot source is one row per task. A target never exceeds
max_repeats times the source; the excess is shared again by weight among the others until none is above. A document
comes floor(rate) times, and once more if a uniform number made of the seed and its id is below the fraction.

Defined results: a null text has size 0; null is a source of its own, the last; a source of size 0 has target 0
and rate 0; rows with equal ids share their draw; an empty table gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted_join, written

WEIGHTS = (3, 1, 2)
SEED = "mix"


def n_words(text: Column) -> Column:
    """The number of runs of anything but space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_: Column, seed: str = SEED) -> Column:
    """In [0, 1), from 32 bits of the MD5 of the seed and the id."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def numbered_sources(sources: DataFrame) -> DataFrame:
    """sources with number: how many come before by code point, null last. Each task numbers its range; the ranges' sizes are added up."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last()]
    place = F.monotonically_increasing_id()
    ranged = written(sources.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", place), "ranged-sources")
    part = F.shiftright("place", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = dict(zip((r.part for r in sizes), itertools.accumulate((r.n for r in sizes), initial=0)))
    if not starts:
        return ranged.withColumn("number", F.col("place")).drop("place")
    start = F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair])[part]
    return ranged.withColumn("number", start + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("place")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """sources: one row (source, source_size) for each source, written. Adds target.

    Sources are numbered in their order by range partitions and the rows before each. Each round then caps the sources that the
    common level would fill beyond their cap and raises the level for the others; it ends when no more are capped.
    Only three sums a round reach the driver.
    """
    at = (F.pmod(F.col("number"), F.lit(len(weights))) + 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at)
    table = numbered_sources(sources).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    table = written(table.drop("number"), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = -1.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, held, open_weight = table.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        level, capped = (share * total - (held or 0.0)) / open_weight, n
    full = F.col("cap") <= F.col("weight") * F.lit(level)
    return table.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(level))).drop("weight", "cap")


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs as one struct column `doc`, with size, source_size, target, copies and taken of each row."""
    seed = options.pop("seed", SEED)
    keyed = docs.select(F.struct("*").alias("doc"), F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"), n_words(F.col("text").cast("string")).alias("size"), uniform(F.col(id_col), seed).alias("draw"))
    sums = keyed.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    sums = sums.withColumn("source", F.when(~F.col("no_source"), F.col("source_key")))
    plan = written(targets(sums, **options).drop("source"), "mix")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")
    joined = counted_join(keyed, plan, ["no_source", "source_key"], "source_rows")
    return joined.select("doc", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with every row as often as the mix takes it."""
    taken = mixing_plan(docs, id_col, **options).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
